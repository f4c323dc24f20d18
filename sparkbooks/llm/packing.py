"""Packing of tokenised documents into sequences of a fixed length, online and in bounded space.

A task tokenises its documents as they come and keeps OPEN windows. Whole sequences are cut off a long document's head; what is left goes to the
window where it fits best. Where it fits in none and no window may be opened, the fullest one is closed: as it is, if at most SLACK tokens are free,
else filled up with the head of what is to be placed. The windows that a task still holds at its end are merged by the same rule in rounds, FAN
tasks' windows by one task, until one is left; it cuts what it has into whole sequences, and the last of these into lengths that are powers of two, so
that it takes no padding.

The vocabulary is broadcast: its size does not depend on the data. Nothing else is; only the windows left over are shuffled, at most OPEN for a task.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbooks.llm.shared import Remembered, id_type, slices, written

LENGTH, OPEN, SLACK = 4096, 16, 16
#: Tasks whose windows left over one task merges.
FAN = 16
#: Words whose ids a worker remembers, the longest of them in bytes, and bytes of text tokenised at once.
REMEMBERED, LONGEST, AT_ONCE = 1 << 19, 64, 1 << 20
#: A tokenizer file above this is not broadcast.
MOST_BYTES = 64 << 20
#: Counts of sequences that one task may number.
NUMBERS = 33
#: Stands between words that are tokenised together; words that hold it are tokenised alone.
MARK = "\x00"

space = re.compile(rb"[\x20\x09-\x0D]")


#: A comma or full stop behind a letter and before white space.
apart = re.compile(rb"[,.](?=[\x20\n])(?<=[a-z][,.])").sub


class Words:
    """Token ids of texts by a tokenizer that drops white space, so that each word between spaces is tokenised once and remembered.

    Where the tokenizer also makes no difference of case and cuts commas and full stops off words, as is tried out first, words are looked up without
    them. New words are tokenised in batches: words of letters alone, one for each token that ends a word, and others with marks between them.
    """

    def __init__(self, description: str):
        import tokenizers

        # a task has one core; the library would start a thread for each of the machine's
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = tokenizers.Tokenizer.from_str(description)
        self.known: Remembered = Remembered(REMEMBERED)
        ids = self._ids
        (self.mark,) = ids(MARK)
        if ids(f" a \n{MARK}b\t") != [*ids("a"), *ids(MARK + "b")]:
            raise ValueError("the tokenizer does not drop white space")
        self.plain = ids("Qjx, eQ.") == [*ids("qjx"), *ids(","), *ids("eq"), *ids(".")]
        parts = json.loads(description)
        suffix = parts["model"].get("end_of_word_suffix")
        # tokens that stand for themselves, but in one case only
        self.added = [t["content"].lower().encode() for t in parts.get("added_tokens") or []]
        # the same model over words of letters that are composed, lower-cased and spelt in the tokenizer's characters for bytes already
        parts |= {"normalizer": None, "pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": " "}, "added_tokens": []}
        self.bare = tokenizers.Tokenizer.from_str(json.dumps(parts))
        tried = "qjx \xe9t\xe9 na\xefve \u03c9\u03c7 \u6f22\u5b57 \U00010428"
        if suffix is None or self.bare.encode(_byte_letters(tried), add_special_tokens=False).ids != ids(tried):
            suffix = None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.plain = self.plain and suffix is not None

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _add(self, words: list[bytes], between: str) -> list[bytes]:
        """Remembers the ids of words, which are tokenised 500 at a time with something between them; those of batches that do not come apart are given back."""
        failed = []
        joined = [between.join(map(bytes.decode, words[k : k + 500])) for k in range(0, len(words), 500)]
        batch = self.bare.encode_batch_fast if between == " " else self.tokenizer.encode_batch_fast
        if between == " ":
            joined = list(map(_byte_letters, joined))
        for k, found in enumerate(batch(joined, add_special_tokens=False)):
            part, ids = words[500 * k : 500 * (k + 1)], np.array(found.ids, "<u4")
            # where words end, and where the next begin
            if between == " ":
                end = 4 * (np.flatnonzero(self.ends[ids]) + 1)
                begin = end[:-1]
            else:
                end = 4 * np.append(np.flatnonzero(ids == self.mark), len(ids))
                begin = end[:-1] + 4
            if len(end) != len(part):
                failed += part
                continue
            raw = ids.tobytes()
            self.known.update(zip(part, map(raw.__getitem__, map(slice, [0, *begin.tolist()], end.tolist())), strict=True))
        return failed

    def _learn(self, words: list[bytes]) -> None:
        letters, others = [], []
        for w in words:
            (letters if self.plain and (w.isalpha() and w.islower() or _letters(w)) else others).append(w)
        others += self._add(letters, " ")
        alone = [w for w in others if b"\x00" in w]
        alone += self._add([w for w in others if b"\x00" not in w], f" {MARK} ")
        for w in alone:
            self.known[w] = self._once(w)

    def _once(self, word: bytes) -> bytes:
        return np.array(self._ids(word.decode()), "<u4").tobytes()

    def ids(self, text: bytes) -> np.ndarray:
        # ASCII letters only join with marks from U+0300 to U+036F, and then not always alike in both cases
        if self.plain and b"\xcc" not in text and b"\xcd" not in text:
            low = text.lower()
            if not any(t in low for t in self.added):
                text = apart(rb" \g<0>", low)
        out = []
        for part in slices(text, space, AT_ONCE):
            words = part.split()
            found = list(map(self.known.get, words))
            new = self.known.unknown({w for w, ids in zip(words, found, strict=True) if ids is None})
            long = [w for w in new if len(w) > LONGEST]
            self._learn([w for w in new if len(w) <= LONGEST] if long else new)
            for w in long:
                self.known[w] = self._once(w)
            find = self.known.__getitem__
            out += [ids or find(w) for w, ids in zip(words, found, strict=True)]
            for w in long:
                del self.known[w]
            self.known.turn()
        return np.frombuffer(b"".join(out), "<u4")


def _letters(word: bytes) -> bool:
    """Whether a word is of letters alone, composed and in lower case."""
    text = word.decode()
    return text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text)


def _byte_table() -> dict[int, int]:
    """How byte-level tokenizers spell bytes: printable ones of Latin-1 as they are, others from U+0100 on. Spaces stay."""
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)} | {32: 32}


BYTES = _byte_table()


def _byte_letters(text: str) -> str:
    return text.encode().decode("latin-1").translate(BYTES)


_words: dict[str, Words] = {}


def _held(description: str) -> Words:
    """A worker's Words for a tokenizer: they outlive a task where Spark uses the worker again."""
    key = hashlib.sha256(description.encode()).hexdigest()
    if key not in _words:
        _words.clear()
        _words[key] = Words(description)
    return _words[key]


class Piece:
    """A stretch of a document's ids. ids holds just the stretch, which starts at `start` of the document's `of` ids."""

    __slots__ = ("doc", "start", "ids", "of")

    def __init__(self, doc, start: int, ids: np.ndarray, of: int):
        self.doc, self.start, self.ids, self.of = doc, start, ids, of


def _cut(pieces: list[Piece], n: int) -> tuple[list[Piece], list[Piece]]:
    """The first n ids of pieces, and the others."""
    head, i = [], 0
    while n and n >= len(pieces[i].ids):
        n -= len(pieces[i].ids)
        head.append(pieces[i])
        i += 1
    tail = pieces[i:]
    if n:
        p = tail[0]
        head.append(Piece(p.doc, p.start, p.ids[:n], p.of))
        tail = [Piece(p.doc, p.start + n, p.ids[n:], p.of), *tail[1:]]
    return head, tail


class Packer:
    """Open windows of one task; closed(pieces) is called with the pieces of each closed one."""

    def __init__(self, closed, length: int = LENGTH, most: int = OPEN, slack: int = SLACK):
        self.closed, self.length, self.most, self.slack = closed, length, most, slack
        self.open: list[list] = []  # [free ids, pieces]

    def place(self, pieces: list[Piece], n: int) -> None:
        """Places pieces of n ids in all, which may be cut."""
        while n >= self.length:
            head, pieces = _cut(pieces, self.length)
            self.closed(head)
            n -= self.length
        while n:
            fits = min((w for w in self.open if w[0] >= n), key=lambda w: w[0], default=None)
            if fits:
                fits[0] -= n
                fits[1] += pieces
                if not fits[0]:
                    self.open.remove(fits)
                    self.closed(fits[1])
                return
            if len(self.open) < self.most:
                self.open.append([self.length - n, list(pieces)])
                return
            fullest = min(self.open, key=lambda w: w[0])
            self.open.remove(fullest)
            if fullest[0] > self.slack:
                head, pieces = _cut(pieces, fullest[0])
                fullest[1] += head
                n -= fullest[0]
            self.closed(fullest[1])

    def last(self) -> None:
        """Closes what is left: whole sequences, and then lengths that are powers of two."""
        pieces, n = [p for w in self.open for p in w[1]], sum(self.length - w[0] for w in self.open)
        self.open = []
        while n:
            size = self.length if n >= self.length else 1 << (n.bit_length() - 1)
            head, pieces = _cut(pieces, size)
            self.closed(head)
            n -= size


class _Rows:
    """Pieces as rows: those of closed sequences have no ids; those of windows left over keep them."""

    def __init__(self, number: int):
        self.next = number << NUMBERS
        self.columns: list[list] = [[] for _ in range(8)]

    def add(self, pieces: list[Piece], left: bool = False) -> None:
        at = 0
        for p in pieces:
            raw = p.ids.tobytes()
            row = (p.doc, p.start, len(p.ids), zlib.crc32(raw), p.of, self.next, at, raw if left else None)
            for column, value in zip(self.columns, row, strict=True):
                column.append(value)
            at += len(p.ids)
        self.next += 1

    def batch(self, kinds: pa.Schema) -> pa.RecordBatch:
        columns, self.columns = self.columns, [[] for _ in range(8)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)


def _kinds(doc: pa.DataType) -> pa.Schema:
    long = pa.int64()
    names = ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    return pa.schema(list(zip(names, [doc, long, long, long, long, long, long, pa.binary()], strict=True)))


def _merger(begin: int, only: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    """A function that merges the windows left over by FAN tasks, and numbers its sequences from task `begin` on. The only one left leaves no windows."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        table = table.drop_columns(["group"]).sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        kinds = _kinds(table.schema.field("doc").type)
        out = _Rows(begin + key[0].as_py())
        packer, names = Packer(out.add), ("doc", "start", "ids", "doc_tokens", "sequence_id")
        window: list[Piece] = []
        before = None
        for doc, start, ids, of, sequence in zip(*(table.column(c).to_pylist() for c in names), strict=True):
            if sequence != before and window:
                packer.place(window, sum(len(p.ids) for p in window))
                window = []
            before = sequence
            window.append(Piece(doc, start, np.frombuffer(ids, "<u4"), of))
        packer.place(window, sum(len(p.ids) for p in window))
        if only:
            packer.last()
        for _, pieces in packer.open:
            out.add(pieces, left=True)
        return pa.Table.from_batches([out.batch(kinds)])

    return merge


def pack(docs: DataFrame, path: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row for each piece of each row of docs.

    A document's ids are those of the tokenizer file at `path`, without special tokens, and then `end`. A null or empty text has `end` alone. A
    piece's ids are `length` ids from `start`, and stand in the sequence from `offset`; ids_crc32 is the unsigned CRC-32 of its ids as little-endian
    32-bit integers. Rows that repeat, and rows without an id, are packed each; no rows give no rows; other columns are not looked at. Texts of any length are
    tokenised whole. sequence_id names a sequence; the numbers have gaps. Pieces are written once to the shared folder, so that what a lost executor held is not packed anew in
    another way.
    """
    with open(path, encoding="utf-8") as f:
        description = f.read(MOST_BYTES + 1)
    if len(description) > MOST_BYTES:
        raise ValueError(f"{path} has over {MOST_BYTES} characters")
    shared = docs.sparkSession.sparkContext.broadcast(description)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, out = _held(shared.value), _Rows(TaskContext.get().partitionId())
        packer, stop, kinds = Packer(out.add), np.array([end], "<u4"), None
        for batch in batches:
            kinds = _kinds(batch.column(0).type)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([words.ids(text.as_buffer().to_pybytes() if text.is_valid else b""), stop])
                packer.place([Piece(doc, 0, ids, len(ids))], len(ids))
            yield out.batch(kinds)
        for _, pieces in packer.open:
            out.add(pieces, left=True)
        if kinds:
            yield out.batch(kinds)

    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc {id_type(rows, 'doc')}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    placed = written(rows.mapInArrow(first, schema), "pack")
    found, number = [], F.shiftright("sequence_id", NUMBERS)
    # the tasks of each round are numbered on from those of the round before
    begin = 0
    while True:
        found.append(placed.where("ids IS NULL").drop("ids"))
        left = placed.where("ids IS NOT NULL")
        most = left.agg(F.max(number)).first()[0]
        if most is None:
            break
        low, begin = begin, most + 1

        group = ((number - low) / FAN).cast("long").alias("group")
        placed = written(left.select("*", group).groupBy("group").applyInArrow(_merger(begin, most - low < FAN), schema), "pack")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("doc", id_col)

"""Token counts under a unigram tokenizer, by dynamic programming over a trie of pre-tokens.

Distinct pre-tokens are inserted in a trie whose nodes hold the forward score (the score and token count of the best way to spell the
prefix that leads there), so each shared prefix is scored once, by whichever pre-token comes first. What the best way to spell a whole pre-token
takes is read off its last node, and a text's count is the sum over its pre-tokens. A task's trie grows from batch to batch and starts
again when it has NODES nodes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbooks.llm.shared import id_type, small_batches

#: Marks a pre-token's begin, where white space stood.
BEGIN = "▁"
#: What a byte of a character that no piece holds scores.
BYTE_SCORE = -30.0
#: Nodes of a task's trie and pre-tokens that it finds at once, at most; texts that are turned into Python strings at once.
NODES, REMEMBERED, ROWS = 400_000, 1 << 17, 256
#: Pre-tokens above this many characters are scored without nodes of the trie, and are not remembered.
LONGEST = 1 << 12

words_of = re.compile(r"[^\x20\x09-\x0D]+").findall


def piece_scores(path: str, most: int = 1 << 20) -> dict[str, float]:
    """The pieces of a sentencepiece model file with unigram scores: a piece of rank r among the n pieces has a
    probability in proportion to 1 / (r + 1), as ranks follow frequency. Control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    if n > most:
        raise ValueError(f"{path} has over {most} pieces")
    plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(plain))))
    return {model.id_to_piece(i): -math.log(r + 1) - total for r, i in enumerate(plain)}


def backward(scores: Mapping[str, float]) -> dict:
    """A trie of the pieces read backwards; a node's score is at the key ''."""
    root: dict = {}
    for piece, score in scores.items():
        node = root
        for c in reversed(piece):
            node = node.setdefault(c, {})
        node[""] = score
    return root


class Trie:
    """A trie of pre-tokens. A node holds its children, and the score and the number of tokens of the best spelling of its prefix.

    Scores that are equal are decided for fewer tokens. A character that no piece ends with in reach is spelt by its bytes.
    """

    def __init__(self, pieces: dict):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.score, self.tokens = [0.0], [0]

    def __len__(self) -> int:
        return len(self.score)

    def spelt(self, word: str, held: int = 1 << 16) -> tuple[int, float]:
        """As count(), for a pre-token of any length: what its last 2 * held prefixes come to is all that is kept. No piece is longer than `held`."""
        score, tokens, begin = [0.0], [0], 0
        for end in range(1, len(word) + 1):
            best, fewest = -math.inf, 0
            node, i = self.pieces, end - 1
            while i >= 0 and (node := node.get(word[i])) is not None:
                s = node.get("")
                if s is not None:
                    s += score[i - begin]
                    if s > best or s == best and tokens[i - begin] + 1 < fewest:
                        best, fewest = s, tokens[i - begin] + 1
                i -= 1
            raw = len(word[end - 1].encode())
            s = score[-1] + BYTE_SCORE * raw
            if s > best:
                best, fewest = s, tokens[-1] + raw
            score.append(best)
            tokens.append(fewest)
            if len(score) > 2 * held:
                del score[:held], tokens[:held]
                begin += held
        return tokens[-1], score[-1]

    def count(self, word: str) -> tuple[int, float]:
        """Inserts a pre-token; its number of tokens and its score."""
        at, path = 0, [0]
        for end, c in enumerate(word, 1):
            below = self.children[at].get(c)
            if below is None:
                below = self._extended(word, end, path)
                self.children[at][c] = below
            at = below
            path.append(at)
        return self.tokens[at], self.score[at]

    def _extended(self, word: str, end: int, path: list[int]) -> int:
        """A new node for the first `end` characters of word; path holds the nodes of its shorter prefixes."""
        score, tokens = self.score, self.tokens
        best, fewest = -math.inf, 0
        node, i = self.pieces, end - 1
        while i >= 0 and (node := node.get(word[i])) is not None:
            s = node.get("")
            if s is not None:
                s += score[path[i]]
                if s > best or s == best and tokens[path[i]] + 1 < fewest:
                    best, fewest = s, tokens[path[i]] + 1
            i -= 1
        raw = len(word[end - 1].encode())
        s = score[path[end - 1]] + BYTE_SCORE * raw
        if s > best:
            best, fewest = s, tokens[path[end - 1]] + raw
        score.append(best)
        tokens.append(fewest)
        self.children.append({})
        return len(score) - 1


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pretokens, n_tokens, score): one row for each row of docs, by the pieces of the model file at `path`.

    A pre-token is a run of anything but white space, with a begin mark. score is the log-likelihood of the text's best spelling. Null and empty
    texts have none of all. Texts are counted whole. Repeated rows are counted each; no rows give no rows; other columns are
    not looked at. The pieces are broadcast: their number does not depend on the data.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(piece_scores(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(backward(shared.value))
        known: dict[str, tuple[int, float]] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part, rows = batch.slice(k, ROWS), []
                for text in part.column(1).to_pylist():
                    counts = Counter(words_of(text or ""))
                    if len(trie) > NODES or len(known) > REMEMBERED:
                        trie.clear()
                        known.clear()
                    own = []
                    for word, n in counts.items():
                        if (found := known.get(word)) is None:
                            if len(word) > LONGEST:
                                found = trie.spelt(BEGIN + word)
                            else:
                                found = known[word] = trie.count(BEGIN + word)
                        own.append((found, n))
                    rows.append((sum(counts.values()), sum(t * n for (t, _), n in own), math.fsum(s * n for (_, s), n in own)))
                columns = list(zip(*rows, strict=True))
                arrays = [part.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n_pretokens", "n_tokens", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {id_type(rows, 'id')}, n_pretokens long, n_tokens long, score double"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)

"""Secret scans: fixed patterns, and strings whose characters look drawn at random.

A window slides over each candidate string; the Shannon entropy of the characters in it is kept up by counts that change by
one character in and one out. Windows count for the character class they are made of (hex digits, or the wider base-64
set), each class with its own threshold. Stretches of passing windows become spans. Strings on the
allow-list, such as UUIDs, example keys, paths and plain words, are left out; spans of the fixed patterns never are.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbooks.llm.shared import id_type, small_batches

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class CharacterClass:
    """Windows of `width` characters of `members` with an entropy of at least `bits` are random."""

    name: str
    members: str
    width: int
    bits: float


CLASSES = (
    CharacterClass("hex", "0123456789abcdefABCDEF", 24, 3.0),
    CharacterClass("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 20, 3.9),
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")

#: Strings that are not secrets, though they can look random. No pattern can match a string in two ways, so none backtracks.
ALLOWED = tuple(
    re.compile(x)
    for x in (
        r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # a UUID
        r"(?:/?[A-Za-z](?:[A-Za-z_-]|/(?=[A-Za-z]))*/?)",  # a path, words run together, or letters alone
        r"[0-9_-]+",  # a number or a date
    )
)


#: Words of strings that are shown as examples. They speak for the part between '/', '_' and '-' that they stand in, and for no other.
SHOWN = re.compile(r"example|sample|dummy|placeholder|changeme|test_?key|your_", re.IGNORECASE)
SEPARATOR = re.compile("[/_-]")


def allowed(candidate: str) -> bool:
    """Whether the whole candidate is of an allowed form."""
    return any(p.fullmatch(candidate) for p in ALLOWED)


def judged(candidate: str) -> list[tuple[int, str]]:
    """The pieces of a candidate, with their places, that are not allowed: what is left beside the parts with a word of SHOWN."""
    pieces, done = [], 0
    for m in SHOWN.finditer(candidate):
        if m.start() < done:
            continue
        begin = max(candidate.rfind(c, done, m.start()) for c in "/_-") + 1 or done
        after = SEPARATOR.search(candidate, m.end())
        pieces.append((done, candidate[done:begin]))
        done = m.end() if m[0].endswith("_") else after.start() if after else len(candidate)
    pieces.append((done, candidate[done:]))
    return [(at, piece) for at, piece in pieces if not allowed(piece.strip("/_-") if len(pieces) > 1 else piece)]


def random_stretches(candidate: str, kind: CharacterClass) -> list[tuple[int, int]]:
    """The unions of the windows of one class whose entropy reaches its threshold, as (start, end).

    Only windows wholly of the class count. With n characters of counts c in a window its entropy is
    log2(n) - sum(c * log2(c)) / n; a step changes two of the terms.
    """
    width, members, out = kind.width, kind.members, []
    if len(candidate) < width:
        return out
    terms = [0.0] + [c * math.log2(c) for c in range(1, width + 2)]  # one comes in before one goes
    counts: dict[str, int] = {}
    inside, spread = 0, 0.0
    for i, c in enumerate(candidate):
        if c in members:
            k = counts.get(c, 0)
            counts[c] = k + 1
            spread += terms[k + 1] - terms[k]
            inside += 1
        if i >= width:
            gone = candidate[i - width]
            if gone in members:
                k = counts[gone]
                counts[gone] = k - 1
                spread -= terms[k] - terms[k - 1]
                inside -= 1
        if inside == width and math.log2(width) - spread / width >= kind.bits - 1e-9:
            start = i + 1 - width
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end), by start and then by kind as listed in KINDS.

    A stretch of random windows that a span of a fixed pattern holds is that secret again and adds nothing.
    """
    spans = []
    lowered = text.lower()
    if any(x in lowered for x in ("passw", "secret", "token", "api")):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if len(max(text.split(), key=len, default="")) >= 20:
        spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
        base = list(spans)
        for m in CANDIDATE.finditer(text):
            found = sorted(
                {(s + at + m.start(), e + at + m.start()) for at, piece in judged(m[0]) for kind in CLASSES for s, e in random_stretches(piece, kind)}
            )
            joined: list[list[int]] = []
            for s, e in found:
                if joined and s <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], e)
                else:
                    joined.append([s, e])
            spans += [("entropy", s, e) for s, e in joined if not any(b[1] <= s and e <= b[2] for b in base)]
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): one row for each row of docs; spans is an array of (kind, start, end, match), in code points, end exclusive.

    A null text counts as empty and has no spans. Texts of any length are searched whole. Repeated rows are searched
    each; no rows give no rows; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("match", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                [{"kind": k, "start": s, "end": e, "match": text[s:e]} for k, s, e in scan(text)] if text else []
                for text in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(span))], ["id", "spans"])

    schema = f"id {id_type(rows, 'id')}, spans array<struct<kind: string, start: long, end: long, match: string>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy) of found spans: their numbers by kind, the digest of the fixed patterns' spans, and all spans.

    A row without spans has zeros, the digest of an empty string, and an empty string. Rows that repeat are digested each; no rows give no rows.
    """
    numbers = {k: F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS}

    def joined(keep: str) -> str:
        return f"array_join(transform(filter(spans, s -> {keep}), s -> concat_ws(':', s.kind, s.start, s.end)), ',')"

    return found.select(
        id_col,
        *[numbers[k] for k in ("assign", "access", "hex")],
        F.sha2(F.expr(joined("s.kind != 'entropy'")), 256).alias("base_sha256"),
        F.expr(joined("true")).alias("spans"),
        numbers["entropy"],
    )


def base_sha256(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans if k != "entropy").encode()).hexdigest()

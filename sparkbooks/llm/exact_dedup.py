"""Exact deduplication by an extendible-hash index whose bucket files lie in the shared folder.

Each text is normalised (each run of white space becomes one space) and hashed; the hash's leading bits name a cell of the
directory. Cells that hold more distinct hashes than a bucket may are split again and again, until each bucket fits or holds one hash.
Each bucket has one owner task, which reads its key range in order, chains the different texts of one hash and compares their
bytes: bucket, hash and place in the chain are a group's name, and all else follows from it. Map tasks send a text once for
all its copies that they hold at a time, with the list of their ids, so a text with very many copies costs an owner some
bodies a map task, and owners hold one chain at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkbooks.llm.shared import id_type, power_of_two, small_batches, written

#: Distinct hashes in a bucket before it is split, cells of the first directory at most (beyond them buckets grow), levels that are counted at once.
CAPACITY, CELLS, LEVELS = 4096, 1 << 15, 6
#: Bytes of bodies, and rows, that a map task combines at a time; bytes of text that an owner task reads, about.
HELD_BYTES, HELD_ROWS, OWNED = 4 << 20, 20_000, 32 << 20

_SPACES = b" \t\n\v\f\r"


def normalised(text: str | None) -> bytes:
    """The text in UTF-8 with each run of white space as one space; null counts as empty."""
    raw = (text or "").encode()
    words = b" ".join(raw.split())
    if not words:
        return b" " if raw else b""
    return b" " * (raw[0] in _SPACES) + words + b" " * (raw[-1] in _SPACES)


def text_key(text: Column) -> Column:
    """The hash by which texts are placed; equal for equal normalised texts."""
    return F.xxhash64(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))


def _combined(kind: pa.DataType):
    """(h, digest, body, ids): one row for each different body of the rows that are held at a time, with the ids that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, list]] = {}
        size = rows = 0

        def out() -> pa.RecordBatch:
            bodies = list(held)
            arrays = [
                pa.array([h for h, _ in held.values()], pa.int64()),
                pa.array([hashlib.sha256(body).digest() for body in bodies], pa.binary()),
                pa.array(bodies, pa.binary()),
                pa.array([ids for _, ids in held.values()], pa.list_(kind)),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["h", "digest", "body", "ids"])

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for own, h, text in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns), strict=True):
                    body = normalised(text)
                    if body in held:
                        held[body][1].append(own)
                    else:
                        held[body] = (h, [own])
                        size += len(body)
                    rows += 1
                    if size > HELD_BYTES or rows > HELD_ROWS:
                        yield out()
                        held.clear()
                        size = rows = 0
        if held:
            yield out()

    return run


def _owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names the group of each entry: the entries of one hash, which arrive one after another, are chained by comparing bytes."""
    last, chain, parts = None, [], []
    for batch in batches:
        places, numbers = [], []
        for bucket, h, body in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if (bucket, h) != last:
                last, chain, parts = (bucket, h), [], []
            at = next((i for i, known in enumerate(chain) if known == body), len(chain))
            if at == len(chain):
                chain.append(body)
                parts.append(0)
            parts[at] += 1
            places.append(at)
            numbers.append(parts[at])
        columns = [batch.column(0), batch.column(1), pa.array(places, pa.int32()), pa.array(numbers, pa.int32()), batch.column(2), batch.column(4)]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "h", "chain", "part", "digest", "ids"])


def _leading(depth: int) -> Column:
    """The leading bits of h, one at least."""
    return F.expr(f"shiftrightunsigned(h, 64 - {depth})")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(cell, leaves) for each cell of the first directory, and its depth; leaves are the (depth, prefix) of the buckets that the cell is split into.

    A bucket is the shortest prefix of the hash that holds at most `capacity` distinct hashes. LEVELS levels are counted in a job, and only
    what is still too full after them goes into the next. The first directory has CELLS cells at most, so it can be broadcast; where
    that makes buckets larger than `capacity`, so be it, as owners read them in order and hold one chain.
    """
    keys = written(keys.select("h").distinct(), "exact-hashes")
    n = keys.count()
    first = min(max(1, power_of_two(n / capacity)), power_of_two(CELLS))
    capacity = max(capacity, n >> first)
    begin, open_, leaves = first, keys, None
    while True:
        end = min(begin + LEVELS, 63)
        counts = open_.groupBy(_leading(end).alias("p")).agg(F.count("*").alias("n"))
        levels = counts.select("n", F.explode(F.sequence(F.lit(begin), F.lit(end))).alias("depth"), "p")
        sizes = levels.groupBy("depth", F.expr(f"shiftright(p, {end} - depth)").alias("prefix")).agg(F.sum("n").alias("n"))
        sizes = sizes.withColumn("fits", (F.col("n") <= capacity) | (F.col("depth") == 63))
        # a prefix is a bucket if it fits and the one above it does not
        above = sizes.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"), F.col("fits").alias("covered"))
        found = sizes.withColumn("above", F.expr("shiftright(prefix, 1)")).join(above, ["depth", "above"], "left")
        found = found.where("fits AND NOT coalesce(covered, false)").select("depth", "prefix")
        leaves = found if leaves is None else leaves.unionByName(found)
        full = written(sizes.where((F.col("depth") == end) & ~F.col("fits")).select(F.col("prefix").alias("p")), "exact-full")
        if end == 63 or full.isEmpty():
            break
        open_ = open_.join(full, _leading(end) == F.col("p"), "left_semi")
        begin = end + 1
    cell = F.expr(f"shiftright(prefix, depth - {first})").alias("cell")
    return leaves.groupBy(cell).agg(F.array_sort(F.collect_list(F.struct("depth", "prefix"))).alias("leaves")), first


def build_index(docs: DataFrame, id_col: str = "id", text_col: str = "text", capacity: int = CAPACITY, key: Callable[[Column], Column] = text_key) -> DataFrame:
    """The index (bucket, h, chain, part, digest, ids) as files in the shared folder; (bucket, h, chain) names a group of equal texts.

    A group has one row, a part, for each time that a map task passed it on. `key` is the hash: a poor one makes chains longer and changes no group.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), key(F.col(text_col)).cast("long").alias("h"), F.col(text_col).cast("string").alias("text"))
    keys = written(source.select("h", F.octet_length("text").alias("size")), "exact-keys")
    cells, first = directory(keys, capacity)
    size = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    kind = id_type(source, "id")
    entries = source.mapInArrow(_combined(_arrow_type(source)), f"h long, digest binary, body binary, ids array<{kind}>")
    placed = entries.withColumn("cell", _leading(first)).join(F.broadcast(cells), "cell")
    leaf = F.expr("filter(leaves, x -> shiftrightunsigned(h, 64 - x.depth) = x.prefix)[0]")
    # a bucket is named by the first hash in it
    placed = placed.withColumn("leaf", leaf).withColumn("bucket", F.expr("shiftleft(leaf.prefix, 64 - leaf.depth)"))
    owned = (
        placed.select("bucket", "h", "digest", "body", "ids")
        .repartition(max(1, -(-size // OWNED)), "bucket")
        .sortWithinPartitions("bucket", "h")
        .mapInArrow(_owner, f"bucket long, h long, chain int, part int, digest binary, ids array<{kind}>")
    )
    return written(owned, "exact-index")


def _arrow_type(source: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(source.schema["id"].dataType)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key: Callable[[Column], Column] = text_key
) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256, chain.

    Of equal texts the row with the smallest id stays. Null texts count as empty, and all empty texts are
    one group. A null id loses to any other; a group with only null ids keeps one of its rows, with
    keep_id null. Of rows that repeat an id and a text, one is kept. No rows give no rows; other columns are
    not looked at. Texts are compared byte by byte, so that no two different ones are ever a group.
    """
    index = build_index(docs, id_col, text_col, capacity, key)
    name = ["bucket", "h", "chain"]
    least = F.array_min("ids")
    best = F.min(F.struct(least.isNull().alias("no"), least.alias("id"), "part"))
    groups = index.groupBy(*name).agg(best.alias("best"), F.sum(F.size("ids").cast("long")).alias("group_size"))
    rows = index.join(groups, name).select("best", "group_size", "digest", "chain", "part", "ids", F.posexplode("ids").alias("at", "id"))
    # the least id is kept once: at its first place in the first entry that has it
    first = F.coalesce(F.expr("array_position(ids, best.id) - 1"), F.lit(0))
    return rows.select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        "group_size",
        ((F.col("part") == F.col("best.part")) & (F.col("at") == first)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "chain",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns.

    Null and empty texts are one group, of which one row stays. Of rows that repeat an id and a text one stays, whichever. No rows give no
    rows. Other columns are not looked at, whatever their names: docs is joined under an alias.
    """
    name = lambda i, sha: F.concat(F.coalesce(F.concat(F.lit("id "), i.cast("string")), F.lit("none")), F.lit(" "), sha).alias("name")
    found = exact_dedup(docs, id_col, text_col).select(name(F.col(id_col), F.col("text_sha256")), "kept")
    gone = found.groupBy("name").agg(F.bool_or("kept").alias("kept")).where(~F.col("kept")).select("name")
    body = F.regexp_replace(F.coalesce(docs[text_col], F.lit("")), r"[\x20\x09-\x0D]+", " ")
    shown = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), name(docs[id_col], F.sha2(F.encode(body, "UTF-8"), 256)))
    # join and window deal rows out by one and the same column, so they travel once
    one = Window.partitionBy("name").orderBy(F.lit(1))
    return shown.join(gone, "name", "left_anti").withColumn("place", F.row_number().over(one)).where("place = 1").select("row.*")

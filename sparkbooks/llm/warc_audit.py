"""WARC records, and a Merkle fixity audit of replicas.

Each record is hashed; records in the order of their offsets are the leaves of a tree whose nodes each cover FANOUT children,
that is an ordered range of offsets. The audit compares the roots of two replicas file by file and descends level by level, only
below nodes that differ. Leaves that differ are matched by their record ids, so that a record which only moved, because one before it was lost, added or
became longer, is no finding. Trees are tables (file, node, begin, end, hash): building one
is an aggregation per level, and a descent a join with the nodes that differed above, so it works on what is damaged, not on the whole.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkbooks.llm.shared import written

FANOUT = 16
#: Records in a file.
RECORDS = 1024


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, record): each page as a WARC/1.0 response record without the two line ends that close it.

    A null url or page counts as empty, a null id as 'null'. Repeated rows give repeated records; no rows give none.
    """
    body = F.coalesce(F.col(html_col), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        F.coalesce(F.col(url_col), F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")),
        F.lit(">\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return pages.select(F.col(id_col).alias("id"), F.concat(head, body).alias("record"))


def filed(records: DataFrame, rows: int, per_file: int = RECORDS) -> DataFrame:
    """(file, number, offset, length, id, leaf): records dealt to files by the hash of the id, and their offsets and hashes there.

    Offsets count the four bytes that close each record. Records without an id are dealt by their own hash. Repeated records are records
    of their own; no rows give none.
    """
    out = _dealt(records, rows, per_file).select("id", "file", (F.octet_length("record") + 4).cast("long").alias("length"), F.sha2("record", 256).alias("leaf"))
    order = Window.partitionBy("file").orderBy("id", "leaf")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return out.select(
        "file",
        (F.row_number().over(order) - 1).cast("long").alias("number"),
        F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"),
        "length",
        F.col("id").cast("string").alias("id"),
        "leaf",
    )


def _dealt(records: DataFrame, rows: int, per_file: int) -> DataFrame:
    files = max(1, -(-rows // per_file))
    key = F.coalesce(F.col("id").cast("string"), F.sha2("record", 256))
    return records.withColumn("file", F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("long") % files)


def write_warc(pages: DataFrame, path: str, rows: int, per_file: int = RECORDS, compression: str = "gzip", **columns: str) -> None:
    """Writes pages as WARC files path/file=N/part-*, one for each file that filed() deals, with records in the order of their ids.

    Spark's text writer does the work, with the records' closing line ends as line separator. A task writes one file at a time. A null url or page counts as empty, a null id
    as 'null'; repeated rows are records each; no rows make no file; other columns are not looked at. With "gzip" a file is one member, so damage can cost all that comes after
    it in the file; with "none" it costs a record.
    """
    dealt = _dealt(warc_records(pages, **columns), rows, per_file)
    order = ["file", "id", F.sha2("record", 256)]
    sorted_ = dealt.repartition(max(1, -(-rows // (8 * per_file))), "file").sortWithinPartitions(*order).select("file", "record")
    sorted_.write.partitionBy("file").option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


MAGIC = b"\x1f\x8b\x08"


def _inflated(data: bytes, at: int) -> Iterator[tuple[bytes, int]]:
    """(piece, end) of a gzip member at a place: its plain bytes piece by piece, with end 0 until the last piece, then the place behind the member, or -1 where it is damaged."""
    member, size = zlib.decompressobj(31), 1 << 11
    while at < len(data):
        try:
            # small pieces first, as most members are small; what lies behind a member is copied out of its last piece
            piece = member.decompress(data[at : at + size])
        except zlib.error:
            break
        at += size
        if member.eof:
            yield piece, min(at, len(data)) - len(member.unused_data)
            return
        yield piece, 0
        size = min(2 * size, 1 << 16)
    yield b"", -1


def _pieces(data: bytes) -> Iterator[tuple[bytes, bool | None]]:
    """(piece, state) of a file's plain bytes, in order: state is None within a member, True at the end of a good one and False where one breaks off. After damage,
    reading goes on at the next member that begins with a version line. A file that is not compressed is one good piece."""
    if not data.startswith(MAGIC[:2]):
        yield data, True
        return
    at = 0
    while 0 <= at < len(data):
        begin = at
        for piece, end in _inflated(data, at):
            yield piece, True if end > 0 else None if not end else False
        if end > 0:
            at = end
            if data[at : at + 2] == MAGIC[:2] or at == len(data):
                continue
            # what follows is no member: damage of its own, unless it is padding
            if data[at:].strip(b"\0"):
                yield b"", False
            begin = at - 1
        at = data.find(MAGIC, begin + 1)
        while at >= 0 and not next(_inflated(data, at))[0].startswith(b"WARC/"):
            at = data.find(MAGIC, at + 1)


class _Records:
    """Finds records in plain bytes that come piece by piece, and holds no more than the record that is not whole yet."""

    def __init__(self) -> None:
        self.held, self.at, self.begin, self.sought = bytearray(), 0, 0, 0

    def add(self, piece: bytes) -> None:
        # what is done with goes once it is most of what is held, so that bytes are moved a bounded number of times
        if self.begin > len(self.held) // 2:
            del self.held[: self.begin]
            self.sought -= self.begin
            self.begin = 0
        self.held += piece

    def whole(self, last: bool) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str]]:
        """The records and broken ranges that are known to end; with `last` nothing more belongs to what is held."""
        held = self.held
        while self.begin < len(held):
            begin, stop, head = self.begin, -1, None
            if held[begin : begin + 5] == b"WARC/":
                end = held.find(b"\r\n\r\n", max(begin, self.sought - 3))
                if end < 0 and not last:
                    self.sought = len(held)
                    return
                if end >= 0:
                    lines = held[begin:end].decode("utf-8", "replace").split("\r\n")[1:]
                    known = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
                    size = known.get("content-length", "")
                    if re.fullmatch("[0-9]{1,15}", size):
                        stop = end + 4 + int(size)
                        if stop + 4 > len(held) and not last:
                            return
                        head = known if held[stop : stop + 4] == b"\r\n\r\n" else None
            elif len(held) - begin < 5 and not last and b"WARC/".startswith(held[begin:]):
                return
            if head is not None:
                body = bytes(held[end + 4 : stop])
                stop += 4
            else:
                after = held.find(b"\r\n\r\nWARC/", max(begin + 1, self.sought - 8))
                if after < 0 and not last:
                    self.sought = len(held)
                    return
                stop = after + 4 if after >= 0 else len(held)
                body = bytes(held[begin:stop])
            leaf = hashlib.sha256(memoryview(held)[begin : stop - 4 if head is not None else stop]).hexdigest()
            yield self.at, self.at + stop - begin, head, body, leaf
            self.at += stop - begin
            self.begin = self.sought = stop


def parsed(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str]]:
    """(begin, end, head, body, leaf) of the records in a file's bytes, end being after the line ends that close a record; names in the head are in lower case, leaf is
    the SHA-256 of the record without those line ends. Places are those of the plain bytes, of which no more than a record is held.

    What is not a whole record, up to the next version line after a closing, comes as one range with None for its head. So does what could be read of a damaged gzip member
    after its last whole record, of no bytes if there is nothing; if the member held one record only, that one is broken.
    """
    found, count, waiting = _Records(), 0, None
    for piece, state in _pieces(data):
        found.add(piece)
        for record in found.whole(state is False):
            if waiting:
                yield waiting
            waiting, count = record, count + 1
        if state is False:
            if waiting and waiting[2] is not None and count == 1:
                waiting = (*waiting[:2], None, *waiting[3:])
            elif not waiting or waiting[2] is not None:
                if waiting:
                    yield waiting
                waiting = (found.at, found.at, None, b"", hashlib.sha256(b"").hexdigest())
        if state is not None:
            if waiting:
                yield waiting
            waiting, count = None, 0
    yield from found.whole(True)


WARC_SCHEMA = "file string, number long, offset long, length long, type string, id string, url string, body string, leaf string, status string"


def read_warc(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """(file, number, offset, length, type, id, url, body, leaf, status): the records of all types in the WARC files under path.

    Files may be compressed by gzip, as a whole or by record; offsets are those of the plain bytes. id is the record's id, leaf the SHA-256 of its bytes
    without the closing line ends, body its text (null if `bodies` is false). Records whose status is 'broken' are ranges that hold no whole record; after one,
    reading goes on at the next version line. Of a damaged gzip member comes what could be read before the damage, and one broken row; the members after it are read.
    Rows of pages are those whose type is 'response'. An empty file gives no rows. Files over 2 GB cannot be read, as a file is one row of Spark's reader.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in WARC_SCHEMA.split(", ")]
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                rows = []
                for number, (begin, end, head, body, leaf) in enumerate(parsed(bytes(content))):
                    known = head or {}
                    text = body.decode("utf-8", "replace") if bodies and head is not None else None
                    row = (name, number, begin, end - begin, known.get("warc-type"), known.get("warc-record-id"), known.get("warc-target-uri"), text, leaf)
                    rows.append((*row, "broken" if head is None else "ok"))
                    if len(rows) == 256:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                yield pd.DataFrame(rows, columns=columns)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(parse, WARC_SCHEMA)


def tree_levels(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of the trees of all files, leaves first: (file, node, begin, end, hash), and the leaves' ids. The last level has one node a file.

    leaves has (file, number, offset, length, id, leaf), as filed() and read_warc() give them. A node's hash is that of its children's numbers, ranges
    and hashes in order. No leaves give one empty level.
    """
    end = F.col("offset") + F.col("length")
    level = leaves.select("file", F.col("number").cast("long").alias("node"), F.col("offset").alias("begin"), end.alias("end"), F.col("leaf").alias("hash"), "id")
    level = written(level, "merkle-0")
    levels = [level]
    most = level.agg(F.max("node")).first()[0] or 0
    while most > 0:
        child = F.struct("node", "begin", "end", "hash")
        level = (
            level.groupBy("file", F.expr(f"node div {fanout}").alias("above"))
            .agg(F.array_sort(F.collect_list(child)).alias("children"), F.min("begin").alias("from"), F.max("end").alias("to"))
            .select(
                "file",
                F.col("above").alias("node"),
                F.col("from").alias("begin"),
                F.col("to").alias("end"),
                F.sha2(F.expr("array_join(transform(children, c -> concat_ws(' ', c.node, c.begin, c.end, c.hash)), ',')"), 256).alias("hash"),
            )
        )
        level = written(level, f"merkle-{len(levels)}")
        levels.append(level)
        most //= fanout
    return levels


def audit(ours: list[DataFrame], theirs: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(file, number, begin, end, id, status) of the records in which two replicas differ, by descent from their roots.

    status is 'damaged' if both have a record of the id in the file and their hashes differ, else 'missing' in theirs or 'added' there. number, begin and end
    are ours where we have the record. Of records that repeat an id in a file, those that differ are matched in their order; records without an id, such as broken
    ranges, with one another. Trees of different heights are compared from the lower root on. Equal replicas, and empty ones, give no rows.
    """
    differing = None
    for depth in reversed(range(min(len(ours), len(theirs)))):
        a, b = (side[depth].select("file", "node", F.struct("begin", "end", "hash").alias(name)) for side, name in ((ours, "a"), (theirs, "b")))
        if differing is not None:
            above = differing.select("file", F.col("node").alias("above"))
            a, b = (x.withColumn("above", F.expr(f"node div {fanout}")).join(above, ["file", "above"], "left_semi").drop("above") for x in (a, b))
        differing = a.join(b, ["file", "node"], "full").where(~F.col("a").eqNullSafe(F.col("b")))
        differing = written(differing.select("file", "node"), "merkle-differing")

    def leaves(level: DataFrame, name: str) -> DataFrame:
        order = Window.partitionBy("file", "id").orderBy("node")
        own = level.join(differing, ["file", "node"], "left_semi").withColumn("nth", F.row_number().over(order))
        key = F.coalesce(F.concat(F.lit("id "), "id"), F.lit("none")).alias("key")
        return own.select("file", key, "nth", F.struct("node", "begin", "end", "hash", "id").alias(name))

    both = leaves(ours[0], "a").join(leaves(theirs[0], "b"), ["file", "key", "nth"], "full").where(~F.col("a.hash").eqNullSafe(F.col("b.hash")))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").otherwise("damaged")
    at = F.coalesce("a", "b")
    return both.select("file", at["node"].alias("number"), at["begin"].alias("begin"), at["end"].alias("end"), at["id"].alias("id"), status.alias("status"))

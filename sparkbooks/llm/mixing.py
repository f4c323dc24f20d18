"""Mixing sources to target weights by a low-discrepancy schedule.

A source's documents, shuffled by the hash of their id, form a stream of tokens that is cut into
blocks of equal token counts: BLOCK at most, and fewer in a small source, which has LEAST_BLOCKS blocks so that whole blocks come near its
target. Slot i of the mix takes the golden-ratio point frac(i * phi), looks up the
source whose share of the cumulative slots holds it, and takes that source's next block, starting again when the
source is used up. Any stretch of the mix thus holds each source in nearly its share.

Everything is in integer arithmetic, so reruns agree on any cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkbooks.llm.shared import WORD, power_of_two, same, written

#: 2^32 / golden ratio, odd: i * GOLDEN mod 2^32 runs through all points of the unit interval in 2^32 steps.
GOLDEN = 2654435769
ONE = 1 << 32
#: Tokens in a block at most, and blocks in a source at least, if it has as many tokens.
BLOCK, LEAST_BLOCKS = 256, 64
#: Equal parts of the unit interval that slots and shares meet in, and slots that one task ranks.
CELLS = 4096
CHUNK_SLOTS = 1 << 16
CHUNK_ROWS = 8192


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, place): size in words, place in the shuffled order of the source. Rows without an id are dealt by their text."""
    text = F.concat(F.lit("null "), F.coalesce(F.xxhash64(text_col), F.lit(0)).cast("string"))
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), text).cast("binary")).alias("place"),
    )


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, target): weights go round the sources by code point, null last.

    The targets share the whole size by weight. One that is above `most` times its source's size stops there and the
    excess is shared again among the rest by weight, until none is above. If every source is at its stop, the
    rest is not handed out. Sources are ranked by size / weight: those that stop are the first ones in this order,
    so one pass of running sums finds them. A null source is one of its own; sources without words have a target of 0; no rows give no rows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    per = per.withColumn("weight", w.cast("long")).withColumn("rank", F.row_number().over(by_name))
    ratio = F.col("source_size") / F.col("weight")
    earlier = Window.orderBy(ratio, "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select(
        "*",
        F.sum("source_size").over(whole).alias("total"),
        F.sum("weight").over(whole).alias("weights"),
        F.coalesce(F.sum("source_size").over(earlier), F.lit(0)).alias("stopped_size"),
        F.coalesce(F.sum("weight").over(earlier), F.lit(0)).alias("stopped_weight"),
    )
    # if all earlier ones stop, the rest have this much for a unit of weight
    unit = (F.col("total") - most * F.col("stopped_size")) / (F.col("weights") - F.col("stopped_weight"))
    stops = unit * F.col("weight") >= most * F.col("source_size")
    per = per.withColumn("unit", unit).withColumn("stops", stops)
    rest = F.min(F.when(~F.col("stops"), F.struct(ratio.alias("r"), "rank", "unit"))).over(whole)["unit"]
    target = F.when(F.col("stops"), (most * F.col("source_size")).cast("double")).otherwise(rest * F.col("weight"))
    return per.select("source", "source_size", "rank", target.alias("target"))


def _blocks(block: int) -> str:
    return f"greatest((source_size + {block - 1}) div {block}, least(source_size, {LEAST_BLOCKS}))"


def schedule(target: DataFrame, block: int = BLOCK, most: int = 3) -> DataFrame:
    """(slot, source, rank, turn, block, epoch): what each slot of the mix takes.

    turn counts a source's slots from 0; the source's blocks come in order, again and again, `most` times at most. A source
    has as many slots as blocks of its size make up its target. A source without words has none, a null source is one like others; no sources give no slots.
    """
    spark = target.sparkSession
    target = target.withColumn("blocks", F.expr(_blocks(block)))
    wanted = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    target = target.withColumn("slots", wanted)
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    share = target.select("source", "blocks", "rank", F.sum("slots").over(upto).alias("c"), "slots")
    total = share.agg(F.coalesce(F.max("c"), F.lit(0.0))).first()[0]
    slots = max(1, int(total + 0.5)) if total > 0 else 0
    share = share.select(
        "source",
        "blocks",
        "rank",
        F.floor((F.col("c") - F.col("slots")) / F.lit(total or 1.0) * ONE).alias("low"),
        F.floor(F.col("c") / F.lit(total or 1.0) * ONE).alias("high"),
    ).where("low < high")
    last = Window.orderBy(F.desc("rank"))
    share = share.withColumn("high", F.when(F.row_number().over(last) == 1, F.lit(ONE)).otherwise(F.col("high")))
    share = share.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("rank")), F.lit(0)))
    width = ONE // CELLS
    share = share.withColumn("cell", F.explode(F.expr(f"sequence(low div {width}, (high - 1) div {width})")))
    points = spark.range(slots).select(
        F.col("id").alias("slot"), ((F.col("id") % ONE + 1) * F.lit(GOLDEN) % ONE).alias("point")
    )
    points = points.withColumn("cell", F.expr(f"point div {width}"))
    placed = points.join(share, "cell").where("point >= low AND point < high")
    placed = placed.withColumn("chunk", F.expr(f"slot div {CHUNK_SLOTS}"))
    before = Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("rank", "chunk")
        .agg(F.count("*").alias("n"))
        .select("rank", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    within = Window.partitionBy("rank", "chunk").orderBy("slot")
    turns = placed.withColumn("at", F.row_number().over(within)).join(starts, ["rank", "chunk"])
    turns = turns.withColumn("turn", F.col("start") + F.col("at") - 1)
    return turns.select(
        "slot",
        "source",
        "rank",
        "turn",
        F.expr("turn % blocks").alias("block"),
        F.expr("turn div blocks").alias("epoch"),
    ).where(f"epoch < {most}")


def offsets(sizes: DataFrame, rows: int) -> DataFrame:
    """sizes with `offset`: the words of the source before the document in its shuffled order.

    Summed in chunks of each source, so that no task sorts a whole source.
    """
    bits = min(40, power_of_two(rows / CHUNK_ROWS) + 3)
    chunk = F.shiftright(F.conv(F.substring("place", 1, 10), 16, 10).cast("long"), 40 - bits)
    s = sizes.withColumn("chunk", chunk)
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        s.groupBy("source", "chunk")
        .agg(F.sum("size").alias("words"))
        .select(
            F.col("source").alias("s"),
            F.col("chunk").alias("c"),
            F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"),
        )
    )
    within = Window.partitionBy("source", "chunk").orderBy("place", "id", "size")
    s = s.withColumn("to", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.join(starts, same(F.col("source"), F.col("s")) & (F.col("chunk") == F.col("c")))
    return s.withColumn("offset", F.col("start") + F.col("to") - F.col("size")).drop("to", "start", "chunk", "s", "c")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    block: int = BLOCK,
    most: int = 3,
) -> DataFrame:
    """One row for each row of docs: id, size, source_size, target, taken, source, copies.

    taken is the number of the document's words in the blocks that the schedule takes, repeats counted: at
    most `most` times the size. copies is how often the schedule takes the block that holds the document's first
    word: the document's number in a mix of whole documents. A null text has size 0; documents without words are
    in no block and have 0 of both. A null source is a source of its own, the last. Rows that repeat an id are
    documents of their own; equal rows are interchangeable. No rows give no rows; other columns
    are not looked at.
    """
    sizes = written(sized(docs, id_col, text_col, source_col), "mix-sizes")
    target = written(targets(sizes, weights, most), "mix-targets")
    taken = schedule(target, block, most).groupBy("rank", "block").agg(F.count("*").alias("times"))
    known = target.select(F.col("source").alias("s"), "source_size", "target", "rank")
    rows = sizes.count()
    placed = offsets(sizes, rows)
    if target.count() <= 10_000:
        known = F.broadcast(known)
    placed = placed.join(known, same(F.col("source"), F.col("s"))).drop("s")
    # a source's first `more` blocks have length + 1 words, the others length; each document is folded with the blocks that it lies in
    cut = placed.where("size > 0").withColumn("blocks", F.expr(_blocks(block)))
    cut = cut.withColumns({"length": F.expr("source_size div blocks"), "more": F.expr("source_size % blocks")})

    def holder(word: str) -> str:
        return f"if({word} < more * (length + 1), ({word}) div (length + 1), more + ({word} - more * (length + 1)) div length)"

    parts = cut.withColumn("block", F.explode(F.expr(f"sequence({holder('offset')}, {holder('offset + size - 1')})")))
    words = F.expr("least(offset + size, (block + 1) * length + least(block + 1, more)) - greatest(offset, block * length + least(block, more))")
    got = (
        parts.select("rank", "block", "offset", words.alias("words"), F.expr(f"block = {holder('offset')}").alias("first"))
        .join(taken, ["rank", "block"])
        .groupBy("rank", "offset")
        .agg(
            F.sum(F.col("words") * F.col("times")).alias("taken"),
            F.sum(F.when(F.col("first"), F.col("times")).otherwise(0)).alias("copies"),
        )
        .select(F.col("rank").alias("r"), F.col("offset").alias("o"), "taken", "copies")
    )
    hit = (F.col("rank") == F.col("r")) & (F.col("offset") == F.col("o")) & (F.col("size") > 0)
    return placed.join(got, hit, "left").select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.col("source").alias(source_col),
        F.coalesce("copies", F.lit(0)).cast("int").alias("copies"),
    )


def sql(block: int = BLOCK) -> str:
    """The same in DuckDB's SQL, for documents whose ids differ and 3 as the most."""
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS place
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS rank
  FROM d GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INTEGER]::BIGINT AS weight FROM per
), run AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         coalesce(sum(source_size) OVER e, 0) AS stopped_size, coalesce(sum(weight) OVER e, 0) AS stopped_weight
  FROM weighed WINDOW e AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), unit AS (
  SELECT *, (total - 3 * stopped_size)::DOUBLE / (weights - stopped_weight)::DOUBLE AS unit FROM run
), stop AS (
  SELECT *, unit * weight >= 3 * source_size AS stops FROM unit
), target AS (
  SELECT source, source_size, rank,
         CASE WHEN stops THEN (3 * source_size)::DOUBLE
              ELSE (SELECT arg_min(unit, struct_pack(a := source_size / weight, b := rank)) FROM stop WHERE NOT stops) * weight END AS target
  FROM stop
), slotted AS (
  SELECT *, CASE WHEN source_size > 0 THEN target * blocks / source_size ELSE 0 END AS slots
  FROM (SELECT *, greatest((source_size + {block - 1}) // {block}, least(source_size, {LEAST_BLOCKS})) AS blocks FROM target)
), cumulated AS (
  SELECT *, sum(slots) OVER (ORDER BY rank) AS c FROM slotted
), total AS (SELECT coalesce(max(c), 0) AS total FROM cumulated),
share AS (
  SELECT source, blocks, rank, floor((c - slots) / total * {ONE})::BIGINT AS low, floor(c / total * {ONE})::BIGINT AS high
  FROM cumulated, total WHERE floor((c - slots) / total * {ONE}) < floor(c / total * {ONE})
), fixed AS (
  SELECT source, blocks, rank, coalesce(lag(h) OVER (ORDER BY rank), 0) AS low, h AS high
  FROM (SELECT *, CASE WHEN rank = (SELECT max(rank) FROM share) THEN {ONE} ELSE high END AS h FROM share)
), numbered AS (
  SELECT slot, (slot % {ONE} + 1) * {GOLDEN} % {ONE} AS point
  FROM (SELECT unnest(range(CASE WHEN total > 0 THEN greatest(1, floor(total + 0.5))::BIGINT ELSE 0 END)) AS slot FROM total)
), turns AS (
  SELECT rank, blocks, row_number() OVER (PARTITION BY rank ORDER BY slot) - 1 AS turn
  FROM numbered JOIN fixed ON point >= low AND point < high
), taken AS (
  SELECT rank, turn % blocks AS block, count(*) AS times FROM turns WHERE turn // blocks < 3 GROUP BY ALL
), blocks AS (
  SELECT rank, b AS block, b * (source_size // blocks) + least(b, source_size % blocks) AS start,
         (b + 1) * (source_size // blocks) + least(b + 1, source_size % blocks) AS stop
  FROM (SELECT *, unnest(range(blocks)) AS b FROM slotted)
), placed AS (
  SELECT doc_id, d.source, size, source_size, target, rank,
         sum(size) OVER (PARTITION BY rank ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT - size AS off
  FROM d JOIN target ON d.source IS NOT DISTINCT FROM target.source
), got AS (
  SELECT doc_id, sum((least(off + size, stop) - greatest(off, start)) * times)::BIGINT AS taken,
         sum(CASE WHEN off >= start THEN times ELSE 0 END)::INTEGER AS copies
  FROM placed JOIN blocks ON placed.rank = blocks.rank AND size > 0 AND off < stop AND off + size > start
  JOIN taken ON taken.rank = blocks.rank AND taken.block = blocks.block GROUP BY doc_id
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, source, coalesce(copies, 0)::INTEGER AS copies
FROM placed LEFT JOIN got USING (doc_id)
"""

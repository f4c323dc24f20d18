"""An audit of how the sources of a language differ in the terms they use, with the vocabulary in minimal acyclic transducers.

The terms that enough documents of a language hold are sorted, and each range of them becomes a transducer: a minimal acyclic automaton whose arcs add
up to the term's place in the sorted order. The texts are streamed through it for exact counts by source: a term that leads to no
final state is not kept, any other becomes an ordinal, and from there on ordinals stand for terms: in shuffles, in blocks of counts, and, since they
sort as the terms do, in ties.

Transducers are broadcast AT_ONCE_BYTES at a time; a larger vocabulary takes further rounds over the texts.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkbooks.llm.shared import slices, written

#: Shares are in parts of SHARE; each count is raised by MORE.
SHARE, MORE = 1_000_000_000, 5
#: Terms of a transducer at most, and bytes of transducers broadcast at once.
TERMS, AT_ONCE_BYTES = 200_000, 64 << 20
#: Different terms that a task counts before it hands the counts on, and bytes of text taken at once.
HELD, SLICE = 1 << 18, 1 << 20
#: Ordinals and sources whose shares are compared at once.
BLOCK, TILE = 1024, 512

#: a-z and bytes of other characters as they are, A-Z lower-cased, all else a space.
TO_TERMS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
space = re.compile(rb"\x20")


class Transducer:
    """A minimal acyclic automaton over bytes that numbers its terms from 0 in sorted order.

    Arcs are sorted by (state, byte); `add` of an arc is the number of terms that leave its state before it, the state's own end included.
    """

    def __init__(self, terms: Iterable[bytes]):
        """terms are different and sorted."""
        self.final: list[bool] = []
        self._count: list[int] = []
        arcs: list[tuple[int, int, int]] = []
        states: dict[tuple, int] = {}
        # the states along the term before: whether it ends there, and its arcs to states that are done
        path: list[tuple[list[bool], list[tuple[int, int]]]] = [([False], [])]
        before = b""

        def done(down_to: int) -> None:
            """Turns the states of the path below `down_to` into numbered ones, equal ones into one."""
            for depth in range(len(before), down_to, -1):
                path[depth - 1][1].append((before[depth - 1], self._state(states, arcs, *path.pop())))

        for term in terms:
            common = 0
            for x, y in zip(before, term, strict=False):
                if x != y:
                    break
                common += 1
            done(common)
            path += [([False], []) for _ in range(common, len(term))]
            path[-1][0][0] = True
            before = term
        done(0)
        self.start = self._state(states, arcs, *path.pop())
        self.n = self._count[self.start]
        table = np.array(sorted(arcs), np.int64).reshape(-1, 4)
        self.keys, self.to, self.add = table[:, 0] * 256 + table[:, 1], table[:, 2], table[:, 3]

    def _state(self, states: dict, arcs: list, end: list[bool], out: list[tuple[int, int]]) -> int:
        key = (end[0], *out)
        if key not in states:
            number = states[key] = len(states)
            passed = int(end[0])
            for byte, to in out:
                arcs.append((number, byte, to, passed))
                passed += self._count[to]
            self.final.append(end[0])
            self._count.append(passed)
        return states[key]

    def packed(self) -> bytes:
        head = np.array([self.start, self.n, len(self.keys), len(self.final)], np.int64)
        return b"".join([head.tobytes(), *(x.tobytes() for x in (self.keys, self.to, self.add)), np.array(self.final, np.bool_).tobytes()])

    @classmethod
    def read(cls, raw: bytes) -> Transducer:
        self = cls.__new__(cls)
        self.start, self.n, arcs, states = np.frombuffer(raw, np.int64, 4).tolist()
        self.keys, self.to, self.add = (np.frombuffer(raw, np.int64, arcs, 32 + 8 * arcs * k) for k in range(3))
        self.final = np.frombuffer(raw, np.bool_, states, 32 + 24 * arcs)
        return self

    def ordinals(self, terms: list[bytes]) -> np.ndarray:
        """The ordinal of each term, -1 for one that is not in; all terms step through the arcs together."""
        length = np.fromiter(map(len, terms), np.int64, len(terms))
        begin, text = np.cumsum(length) - length, np.frombuffer(b"".join(terms), np.uint8)
        state, out = np.full(len(terms), self.start), np.zeros(len(terms), np.int64)
        on, depth = np.arange(len(terms)), 0
        while len(on := on[length[on] > depth]):
            key = state[on] * 256 + text[begin[on] + depth]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == key if len(self.keys) else np.zeros(len(on), bool)
            out[on[~hit]] = -1
            on, at = on[hit], at[hit]
            state[on] = self.to[at]
            out[on] += self.add[at]
            depth += 1
        out[(out >= 0) & ~np.asarray(self.final)[state]] = -1
        return out


def _text(column: pa.Array) -> Iterator[bytes]:
    for text in column:
        yield (text.as_buffer().to_pybytes() if text.is_valid else b"").translate(TO_TERMS)


def document_counts(rows: DataFrame) -> DataFrame:
    """(lang, term, n): n documents of the language hold the term. rows are (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                arrays = [pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "term", "n"])
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), _text(batch.column(1)), strict=True):
                terms: set[bytes] = set()
                for part in slices(text, space, SLICE):
                    terms.update(part.split())
                counts[lang].update(terms)
                if sum(map(len, counts.values())) > HELD:
                    yield from out()
        yield from out()

    found = rows.select("lang", "text").mapInArrow(run, "lang string, term binary, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def vocabulary(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (lang, term): transducers (lang, first, shard, base, machine), and the terms as (lang, ordinal, term).

    The terms are sorted in range partitions; each run of TERMS terms of a language in one becomes a transducer, whose terms' ordinals in their language begin
    at base.
    """
    schema = "lang string, shard long, ordinal long, term binary, machine binary"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        lang, terms = None, []

        def out() -> pa.RecordBatch:
            nonlocal shard
            shard += 1
            n = len(terms)
            machine = Transducer(terms).packed()
            columns = [[lang] * (n + 1), [shard] * (n + 1), [*range(n), None], [*terms, terms[0]], [None] * n + [machine]]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            terms.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "shard", "ordinal", "term", "machine"])

        for batch in batches:
            for own, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if terms and (own != lang or len(terms) == TERMS):
                    yield out()
                lang = own
                terms.append(term)
        if terms:
            yield out()

    ordered = kept.select("lang", "term").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    rows = written(ordered.mapInArrow(build, schema), "vocabulary")
    # a row for each transducer
    sizes = rows.where("machine IS NULL").groupBy("shard").agg(F.count("*").alias("n"))
    machines = rows.where("machine IS NOT NULL").select("lang", F.col("term").alias("first"), "shard", "machine").join(sizes, "shard")
    base = F.sum("n").over(Window.partitionBy("lang").orderBy("first")) - F.col("n")
    machines = machines.withColumn("base", base).drop("n")
    terms = rows.where("machine IS NULL").join(machines.select("shard", "base"), "shard")
    return machines, terms.select("lang", (F.col("ordinal") + F.col("base")).alias("ordinal"), "term")


def term_counts(rows: DataFrame, machines: DataFrame) -> DataFrame:
    """(lang, source, ordinal, n): occurrences in rows (lang, source, text) of the terms of the language's transducers."""
    spark = rows.sparkSession
    schema = "lang string, source string, ordinal long, n long"
    sizes = machines.select("shard", F.octet_length("machine").alias("bytes")).orderBy("shard").collect()
    rounds: list[list[int]] = []
    held = AT_ONCE_BYTES
    for shard, size in sizes:
        if held + size > AT_ONCE_BYTES:
            rounds.append([])
            held = 0
        rounds[-1].append(shard)
        held += size
    out = spark.createDataFrame([], schema)
    for shards in rounds:
        found = machines.where(F.col("shard").between(shards[0], shards[-1])).select("lang", "first", "base", "machine").collect()
        shared = spark.sparkContext.broadcast(sorted((r.lang, bytes(r.first), r.base, bytes(r.machine)) for r in found))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own: dict[str, list[tuple[bytes, int, Transducer]]] = defaultdict(list)
            for lang, first, base, raw in shared.value:
                own[lang].append((first, base, Transducer.read(raw)))
            counts: dict[tuple[str, str], Counter] = defaultdict(Counter)

            def out() -> Iterator[pa.RecordBatch]:
                for (lang, source), found in counts.items():
                    terms = sorted(found)
                    for k, (first, base, machine) in enumerate(own[lang]):
                        end = bisect_left(terms, own[lang][k + 1][0]) if k + 1 < len(own[lang]) else len(terms)
                        part = terms[bisect_left(terms, first) : end]
                        ordinal = machine.ordinals(part)
                        n = np.fromiter(map(found.__getitem__, part), np.int64, len(part))
                        ordinal, n = ordinal[ordinal >= 0] + base, n[ordinal >= 0]
                        names = [pa.array([x] * len(n), pa.string()) for x in (lang, source)]
                        yield pa.RecordBatch.from_arrays([*names, pa.array(ordinal), pa.array(n)], ["lang", "source", "ordinal", "n"])
                counts.clear()

            for batch in batches:
                for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _text(batch.column(2)), strict=True):
                    if lang in own:
                        for part in slices(text, space, SLICE):
                            counts[lang, source].update(part.split())
                            if sum(map(len, counts.values())) > HELD:
                                yield from out()
            yield from out()

        out = out.unionByName(rows.select("lang", "source", "text").mapInArrow(run, schema))
    return out.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def _share(count: Column, total: Column, terms: Column, more: int) -> Column:
    """1 + floor(SHARE * (count + more) / (total + more * terms)), exactly; null without terms."""
    over = (count.cast("decimal(20,0)") + more) * F.lit(SHARE).cast("decimal(10,0)")
    whole = F.call_function("div", over.cast("decimal(38,0)"), (total.cast("decimal(20,0)") + more * terms.cast("decimal(18,0)")).cast("decimal(38,0)"))
    return F.when(terms > 0, whole + 1)


def _distances(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value): for sources numbered a < b of a language, the sum of what their shares of all terms differ by.

    shares (lang, i, ordinal, p) are of the terms that source i has; groups (lang, i, terms, sources, none) say what a source's share of any other term is. They meet in blocks
    of BLOCK ordinals and two tiles of TILE sources, which hold TILE * 2 * BLOCK shares at most.
    """
    every = groups.select("lang", "i", F.explode(F.expr(f"sequence(0, terms div {BLOCK})")).alias("block"), F.lit(-1).cast("long").alias("ordinal"), F.col("none").alias("p"), "terms", "sources")
    given = shares.select("lang", "i", F.expr(f"ordinal div {BLOCK}").alias("block"), "ordinal", "p", F.lit(0).cast("long").alias("terms"), "sources")
    other = F.explode(F.expr(f"sequence(0, (sources - 1) div {TILE})")).alias("other")
    both = every.unionByName(given).select("lang", "i", "block", "ordinal", "p", "terms", F.expr(f"i div {TILE}").alias("tile"), other)
    both = both.select("lang", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), "block", "i", "ordinal", "p", "terms")
    schema = "lang string, a long, b long, value long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        place = tiles = None
        sums = np.zeros(0)

        def block() -> None:
            """Adds what the sources of the two tiles differ by in the block that is held."""
            i, ordinal, p, terms = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in (4, 5, 6, 7))
            _, ta, tb, number = place
            none = ordinal < 0
            at = np.concatenate([np.arange(ta * TILE, (ta + 1) * TILE), np.arange(tb * TILE, (tb + 1) * TILE)])[: TILE if ta == tb else 2 * TILE]
            at = at[np.isin(at, i[none])]
            rest = np.zeros(len(at), np.int64)
            rest[np.searchsorted(at, i[none])] = p[none]
            n = min(BLOCK, int(terms[none].max()) - number * BLOCK)
            met, column = np.unique(ordinal[~none], return_inverse=True)
            table = np.repeat(rest[:, None], len(met), axis=1)
            table[np.searchsorted(at, i[~none]), column] = p[~none]
            first = int(np.searchsorted(at, (ta + 1) * TILE)) if ta != tb else 0
            for k in range(len(at) if ta == tb else first):
                others = slice(k + 1 if ta == tb else first, None)
                more = np.abs(table[others] - table[k]).sum(axis=1) + (n - len(met)) * np.abs(rest[others] - rest[k])
                sums[at[k] - ta * TILE, at[others] - tb * TILE] += more
                seen[at[k] - ta * TILE, at[others] - tb * TILE] = True
            held.clear()

        def out() -> pa.RecordBatch:
            a, b = np.nonzero(seen)
            lang = pa.array([tiles[0]] * len(a), pa.string())
            return pa.RecordBatch.from_arrays([lang, pa.array(a + tiles[1] * TILE), pa.array(b + tiles[2] * TILE), pa.array(sums[a, b])], ["lang", "a", "b", "value"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True))
            begin = 0
            while begin < len(keys):
                end = bisect_right(keys, keys[begin], begin)
                if keys[begin] != place:
                    if held:
                        block()
                    if tiles and keys[begin][:3] != tiles:
                        yield out()
                    if keys[begin][:3] != tiles:
                        tiles = keys[begin][:3]
                        sums, seen = np.zeros((TILE, TILE), np.int64), np.zeros((TILE, TILE), bool)
                    place = keys[begin]
                held.append(batch.slice(begin, end - begin))
                begin = end
        if held:
            block()
            yield out()

    order = ["lang", "ta", "tb", "block"]
    parts = both.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, schema)
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame, least: int = 30, top: int = 50, more: int = MORE, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """(lang, source, part, item, value, rank): what sets each source of a language apart.

    Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased. A language keeps the terms that `least` of its documents hold. A source's share
    of a kept term is 1 + floor(SHARE * (count + more) / (total + more * terms)), and so is the language's. Part `pair` has, for each other source of the language,
    the sum over all kept terms of what the shares differ by. Part `term` has the `top` terms that the source holds with a share above the language's, by how much.
    Ranks go by value downwards, then by item in UTF-8 order.

    Null text, lang and source count as ''. A source without terms, or of a language that keeps none, has pairs but no terms. Rows that repeat count each; no rows
    give no rows; other columns are not looked at. Texts are read whole. Results do not depend on partitioning.
    """
    empty = F.lit("")
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    kept = written(document_counts(rows).where(F.col("n") >= least).select("lang", "term"), "kept")
    machines, terms = vocabulary(kept)
    machines = written(machines, "transducers")
    counts = written(term_counts(rows, machines), "term-counts")

    whole = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("n"))
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = Window.partitionBy("lang")
    groups = rows.select("lang", "source").distinct().join(by_lang, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["terms", "total"])
    groups = groups.select(
        "*",
        (F.row_number().over(of_lang.orderBy("source")) - 1).cast("long").alias("i"),
        F.count("*").over(of_lang).alias("sources"),
        F.sum("total").over(of_lang).alias("lang_total"),
    )
    none = F.coalesce(_share(F.lit(0), F.col("total"), F.col("terms"), more), F.lit(0).cast("long")).alias("none")
    groups = written(groups.select("*", none), "groups")

    shares = counts.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms"), more))
    by_value = Window.partitionBy("lang", "source")
    over = whole.withColumnRenamed("n", "lang_n").join(shares, ["lang", "ordinal"])
    over = over.withColumn("value", F.col("p") - _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"), more)).where("value > 0")
    over = over.withColumn("rank", F.row_number().over(by_value.orderBy(F.desc("value"), "ordinal"))).where(F.col("rank") <= top)
    part_term = over.join(terms, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")

    pairs = written(_distances(shares, groups), "distances")
    pairs = pairs.unionByName(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = lambda i, as_: groups.select("lang", F.col("i").alias(i), F.col("source").alias(as_))
    pairs = pairs.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    rank = F.row_number().over(by_value.orderBy(F.desc("value"), "item"))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank")).unionByName(part_term)


def sql(least: int = 30, top: int = 50, more: int = MORE) -> str:
    """The same rows by DuckDB."""
    share = f"1 + ({SHARE}::HUGEINT * ({{n}} + {more})) // ({{total}} + {more} * v)"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM (SELECT DISTINCT r, lang, term FROM t) GROUP BY lang, term HAVING count(*) >= {least}),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
f AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, v FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (
  SELECT *, {share.format(n="n", total="(sum(n) OVER (PARTITION BY lang, source))")} AS p FROM f
), q AS (
  SELECT lang, term, {share.format(n="n", total="(sum(n) OVER (PARTITION BY lang))")} AS q FROM (SELECT lang, term, sum(n) AS n, any_value(v) AS v FROM f GROUP BY lang, term)
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
QUALIFY part = 'pair' OR rank <= {top}
"""

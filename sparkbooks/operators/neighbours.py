"""Exact nearest vectors by angle, with pivots: what cannot hold a nearer vector than those known is not compared.

Blocks of listings meet deals of queries by the key of both, so a task holds one of each, of a fixed size, whatever the tables' sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkbooks.sources.shared import written

#: Pivots at most, and components of all of them at most: they are broadcast.
PIVOTS, PIVOT_VALUES = 1024, 1 << 22
#: Listings of a block, and queries, that a task holds at once, and components of each at most; up to SMALL listings are one cell, as there is nothing to win by leaving some out.
BLOCK, BLOCK_VALUES = 16384, 1 << 21
SMALL = 8192
#: Similarities, angles or components that a step holds in memory at once.
HELD = 1 << 20
#: Angles are bounded with this allowance for rounding, and similarities count as equal to this many digits.
ALLOWANCE, DIGITS = 1e-6, 12


def _unit(values: pd.Series) -> np.ndarray:
    x = np.array(values.tolist(), float).reshape(len(values), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column of lists, of length 1."""
    x = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _pieces(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for begin in range(0, len(frame), rows):
            yield frame.iloc[begin : begin + rows]


def nearest_of(q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, similarity) of the k of x that are nearest to each of q, of equal ones those with the smaller ids; vectors have the length 1. Listings go by in steps, and only
    those that are as near as the k-th known so far are sorted."""
    least = np.full(len(q), -np.inf)
    row, best, near = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    step = max(k, HELD // max(1, len(q)), 1)
    for begin in range(0, len(x), step):
        s = q @ x[begin : begin + step].T
        bound = least
        if s.shape[1] > k:
            bound = np.maximum(least, np.partition(s, -k, axis=1)[:, -k]) if begin == 0 else least
        at, place = np.nonzero(s >= bound[:, None] - 2 * 10.0**-DIGITS)
        if not len(at):
            continue
        row, best = np.concatenate([row, at]), np.concatenate([best, ids[begin + place]])
        near = np.concatenate([near, np.round(s[at, place], DIGITS)])
        order = np.lexsort((best, -near, row))
        row, best, near = row[order], best[order], near[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        least[row[rank == k - 1]] = near[rank == k - 1]
        row, best, near = (c[rank < k] for c in (row, best, near))
    return row, best, near


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(i, v) without vectors that are null, hold null or non-finite components, or have no length."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), v.alias("v"))
    return rows.where(F.col("v").isNotNull() & F.col("i").isNotNull()).where(~odd & F.exists("v", lambda x: x != 0))


class Index:
    """Listings dealt to the nearest of some pivots. A cell knows how many it has and how far from its pivot they reach."""

    def __init__(self, listings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None):
        """Reads listings some times, and writes its blocks to the shared folder, where each search reads them. pivots: their number; else one for up to
        SMALL listings, and for more one for each block, about the root of their number at most."""
        rows = _usable(listings, id_col, vector_col)
        first = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
        self.n, dimensions = first.n, max(1, first.d or 1)
        most = max(1, min(PIVOTS, PIVOT_VALUES // dimensions))
        self.block = max(1, min(BLOCK, BLOCK_VALUES // dimensions))
        wanted = min(most, pivots or (1 if self.n <= SMALL else min(int(self.n**0.5) + 1, 4 + self.n // self.block)))
        # any vectors will do as pivots; the hash of the id picks the same ones each time
        drawn = rows.orderBy(F.xxhash64("i"), "i").limit(wanted).select("v").collect()
        spark = listings.sparkSession
        self.pivots = spark.sparkContext.broadcast(_unit(pd.Series([r.v for r in drawn])) if drawn else np.zeros((0, dimensions)))
        shared = self.pivots

        def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in _pieces(frames, max(1, HELD // max(dimensions, len(shared.value)))):
                angle = _angle(_unit(frame["v"]), shared.value)
                cell = angle.argmin(axis=1)
                yield pd.DataFrame({"i": frame["i"].to_numpy(), "v": frame["v"].to_numpy(), "cell": cell, "angle": angle[np.arange(len(cell)), cell]})

        dealt = rows.mapInPandas(deal, "i long, v array<double>, cell int, angle double")
        cells = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("reach")).collect()
        # a row for each pivot at most
        self.size, self.reach = np.zeros(len(drawn), np.int64), np.zeros(len(drawn))
        for r in cells:
            self.size[r.cell], self.reach[r.cell] = r.n, r.reach
        # a cell of any size is dealt on by the id's hash, so that no block is much larger than the others
        parts = self._parts()
        of_cell = lambda values: F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("cell") + 1) if drawn else F.lit(1)
        block = of_cell(np.cumsum(parts) - parts) + F.pmod(F.xxhash64("i"), of_cell(parts))
        self.blocks = written(dealt.select(block.cast("int").alias("block"), "i", "v"), "cells")

    def _parts(self) -> np.ndarray:
        """How many blocks each cell has."""
        return np.maximum(1, -(-self.size // self.block))

    def _visits(self, queries: DataFrame, k: int, second: bool) -> DataFrame:
        """(q, v, block): the blocks that a query looks at. First those of the cells with the least bounds that hold k vectors together; the second time
        (queries have `worst`, the angle of their k-th vector so far) all others that can hold one as near."""
        shared, size, reach, split = self.pivots, self.size, self.reach, self._parts()
        rows = max(1, HELD // max(1, int(split.sum())))

        def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in _pieces(frames, rows) if len(size) else ():
                bound = np.maximum(0.0, _angle(_unit(frame["v"]), shared.value) - reach)
                bound[:, size == 0] = np.inf
                order = np.argsort(bound, axis=1, kind="stable")
                held = np.cumsum(size[order], axis=1)
                first = np.zeros(bound.shape, bool)
                np.put_along_axis(first, order, held - size[order] < k, axis=1)
                first &= size > 0
                if second:
                    first = ~first & (bound <= frame["worst"].to_numpy()[:, None] + ALLOWANCE)
                blocks = np.repeat(first, split, axis=1)
                yield pd.DataFrame({"q": frame["q"].to_numpy(), "v": frame["v"].to_numpy(), "blocks": [np.flatnonzero(b).astype(np.int32) for b in blocks]})

        # vectors are repeated for their blocks by Spark, not in Python
        return queries.mapInPandas(visit, "q long, v array<double>, blocks array<int>").select("q", "v", F.explode("blocks").alias("block"))

    def _best(self, asked: DataFrame, k: int, second: bool) -> DataFrame:
        """(query, id, similarity): the k best of each block that a query visits."""
        keys = ["block", "deal"]
        # a deal of a block's queries is no larger than a block, as long as ids do not repeat
        deals = max(1, -(-asked.count() // self.block))
        queries = self._visits(asked, k, second).select("block", F.pmod(F.xxhash64("q"), F.lit(deals)).cast("int").alias("deal"), F.col("q").alias("id"), "v")
        listings = self.blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"), F.col("i").alias("id"), "v")
        schema = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64())])

        def best(asked: pa.Table, held: pa.Table) -> pa.Table:
            found = []
            if len(asked) and len(held):
                x, ids = _matrix(held["v"]), held["id"].to_numpy()
                for begin in range(0, len(asked), 256):
                    some = asked.slice(begin, 256)
                    row, best, near = nearest_of(_matrix(some["v"]), ids, x, k)
                    found.append(pa.table([some["id"].to_numpy()[row], best, near], schema))
            return pa.concat_tables(found) if found else schema.empty_table()

        return queries.groupBy(*keys).cogroup(listings.groupBy(*keys)).applyInArrow(best, "query long, id long, similarity double")

    def search(self, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """(query, id, similarity, place): the k listings nearest to each query, exactly; of equal ones the smaller id first.

        Each query first looks at the cells that may lie nearest until they hold k vectors. A vector at angle a from a pivot is at least |angle(query, pivot) - a|
        from the query, so of the other cells only those are looked at whose bound is not above the k-th angle found. Blocks meet queries by a
        join on the cell. Vectors that are null, hold null or non-finite components, or have no length are neither queries nor listings; with fewer than k
        listings all are given. Rows that repeat count each.
        """
        asked = _usable(queries, id_col, vector_col).withColumnRenamed("i", "q")
        by_near = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
        top = lambda found: found.withColumn("place", F.row_number().over(by_near)).where(F.col("place") <= k)
        first = top(self._best(asked, k, False))
        if len(self.size) < 2:
            return first
        first = written(first.drop("place"), "nearest")
        worst = first.groupBy("query").agg(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.min("similarity")))).alias("worst"))
        rest = self._best(asked.join(worst, asked["q"] == worst["query"]).select("q", "v", "worst"), k, True)
        return top(first.unionByName(rest))

    def visited(self, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """(query, compared, listings): how many of the listings a search compares with each query."""
        asked = _usable(queries, id_col, vector_col).withColumnRenamed("i", "q")
        last = self.search(queries, k, id_col, vector_col).groupBy("query").agg(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.min("similarity")))).alias("worst"))
        again = asked.join(last, asked["q"] == last["query"]).select("q", "v", "worst")
        both = self._visits(asked, k, False).unionByName(self._visits(again, k, True)).drop("v").distinct()
        sizes = self.blocks.groupBy("block").agg(F.count("*").alias("n"))
        per = both.join(sizes, "block").groupBy(F.col("q").alias("query")).agg(F.sum("n").alias("compared"))
        return per.withColumn("listings", F.lit(self.n).cast("long"))


def cosine_top_k(queries: DataFrame, listings: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None) -> DataFrame:
    """Index.search() of queries among listings."""
    return Index(listings, id_col, vector_col, pivots).search(queries, k, id_col, vector_col)


def voice_search(queries: DataFrame, voices: DataFrame, k: int = 5, id_col: str = "voice_id", vector_col: str = "embedding", query_col: str | None = None, pivots: int | None = None) -> DataFrame:
    """(query, place, score, and the columns of voices but the vector): the k voices nearest to each query vector, with what the listing says of them.

    query_col names the queries' ids, id_col if it is not given. Listings of one id all come with it. Queries without a usable vector have no rows.
    """
    found = Index(voices, id_col, vector_col, pivots).search(queries, k, query_col or id_col, vector_col)
    shown = voices.drop(vector_col)
    return found.select("query", F.col("id").alias(id_col), F.col("similarity").alias("score"), "place").join(shown, id_col)

"""Near-duplicate vectors by collision counting over many one-dimensional projections.

Two sets of random directions make a family of projections, one for each pair of directions: the projection on their sum. Each
projection's values are sorted, but only their upper ends are looked at: a vector stands in the lists of the projections on which it is extreme, those
whose two directions are among the `TOP` with the largest products. (In whole sorted projections a window that holds near vectors
would hold a fixed share of all others too.) Near vectors are extreme on the same projections, while the number of projections
grows with the number of vectors, so lists keep their length. In a list a vector queries the window around its own value; a pair that meets in
the windows of enough projections is verified by its cosine in double precision. Windows and the least count are calibrated on a bounded sample
so that pairs at the threshold itself are found with the wanted recall.

A pair is counted and verified in the first list that it shares, where the vectors bring the numbers and products of their directions along, so
no pairs are shuffled. Lists that are long are cut into blocks and handled by pairs of blocks. Only counts and a spanning set of the links leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbooks.llm.shared import components, small_batches, written

#: Vectors in a list that are aimed at, directions of each set that a vector is extreme on, and independent tables.
LENGTH, TOP, TABLES = 32, 3, 3
#: Tables at most: where as many find too few pairs, as at a low cosine, all pairs are compared in blocks instead.
MOST_TABLES = 24
#: Vectors that the calibration looks at, the recall it wants at the threshold, and the number of standard deviations in a window.
CALIBRATED, RECALL, WINDOW = 1000, 0.99, 3.5
#: Vectors in a block of a long list; pairs compared at once.
BLOCK, AT_ONCE = 1024, 200_000
#: Bytes of all tables of directions, which are broadcast, at most: enough for 10^8 vectors of 64 dimensions in the most tables. Beyond, lists grow longer.
MOST_BYTES = 256 << 20


@dataclass
class Projections:
    """TABLES pairs of direction sets, and the half width of the windows."""

    first: np.ndarray  # tables x directions x dimensions
    second: np.ndarray
    window: float
    least: int = 1

    def ends(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The directions that each unit vector is extreme on, and its products with them: both vectors x tables x 2 x TOP."""
        top = min(TOP, self.first.shape[1])
        numbers = np.empty((len(x), len(self.first), 2, top), np.int32)
        products = np.empty(numbers.shape, np.float32)
        for t in range(len(self.first)):
            for side, directions in enumerate((self.first[t], self.second[t])):
                a = x @ directions.T
                best = np.argsort(-a, axis=1, kind="stable")[:, :top] if a.shape[1] <= 4 * top else _largest(a, top)
                numbers[:, t, side], products[:, t, side] = best, np.take_along_axis(a, best, 1)
        return numbers, products

    def counting(self) -> Counting:
        return Counting(self.first.shape[1], self.window, self.least)


def _largest(a: np.ndarray, top: int) -> np.ndarray:
    """The columns of the `top` largest numbers of each row, the largest first."""
    some = np.argpartition(-a, top, axis=1)[:, :top]
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(a, some, 1), axis=1, kind="stable"), 1)


@dataclass
class Counting:
    """What counting needs to know of the projections: how many directions a set has, the half width of the windows, and the least count."""

    directions: int
    window: float
    least: int

    def lists(self, numbers: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of the vectors and their values there: both vectors x (tables * TOP * TOP)."""
        table = np.arange(numbers.shape[1], dtype=np.int64)[None, :, None, None] * self.directions
        own = (table + numbers[:, :, 0, :, None]) * self.directions + numbers[:, :, 1, None, :]
        sums = products[:, :, 0, :, None] + products[:, :, 1, None, :]
        return own.reshape(len(numbers), -1), sums.reshape(len(numbers), -1) / math.sqrt(2)

    def collisions(self, na: np.ndarray, pa: np.ndarray, nb: np.ndarray, pb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pair of rows the number of projections in whose windows they meet, and the first of those."""
        # the difference of the products on each direction of a that b has as well
        met = na[..., :, None] == nb[..., None, :]
        apart = np.where(met, pa[..., :, None] - pb[..., None, :], np.nan)
        with np.errstate(all="ignore"):
            apart = np.where(met.any(axis=-1), np.nansum(apart, axis=-1), np.nan)
        close = np.abs(apart[:, :, 0, :, None] + apart[:, :, 1, None, :]) <= self.window * math.sqrt(2)
        close = close.reshape(len(na), -1)
        numbers = self.lists(na, pa)[0]
        return close.sum(axis=1), np.where(close, numbers, np.iinfo(np.int64).max).min(axis=1)


def calibrated(n: int, dimensions: int, cosine: float, sample: np.ndarray, seed: int = 7) -> Projections | None:
    """Projections for n vectors. The least count is the largest that still finds RECALL of pairs at the threshold, each made from a sampled
    vector and a random direction; tables are added while even a count of one finds fewer. None if they do not help."""
    rng = np.random.default_rng(seed)
    m = min(math.ceil(math.sqrt(n * TOP * TOP / LENGTH)), MOST_BYTES // (16 * dimensions * MOST_TABLES))
    m = max(2, m)
    # the difference of near vectors has this standard deviation on a direction of standard normal numbers
    window = WINDOW * math.sqrt(2 - 2 * cosine)
    u = sample if len(sample) else rng.standard_normal((8, dimensions))
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    off = rng.standard_normal(u.shape)
    off -= (off * u).sum(1, keepdims=True) * u
    off /= np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-12)
    near = cosine * u + math.sqrt(1 - cosine * cosine) * off
    tables = TABLES
    while True:
        made = Projections(rng.standard_normal((tables, m, dimensions)), rng.standard_normal((tables, m, dimensions)), window)
        counts = made.counting().collisions(*made.ends(u), *made.ends(near))[0]
        found = [c for c in range(1, tables * TOP * TOP + 1) if (counts >= c).mean() >= RECALL]
        if found:
            made.least = max(found)
            return made
        if tables >= MOST_TABLES:
            return None
        tables += 1


def _unit(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows are usable: of the right length, finite and not zero."""
    rows = column.to_pylist()
    good = np.array([r is not None and len(r) == dimensions and None not in r for r in rows], bool)
    x = np.zeros((len(rows), dimensions))
    if good.any():
        x[good] = np.array([r for r, g in zip(rows, good, strict=True) if g], float)
    with np.errstate(over="ignore", invalid="ignore"):
        largest = np.abs(x).max(axis=1, initial=0)
        good &= np.isfinite(x).all(axis=1) & (largest > 0)
        x[good] /= largest[good, None]
        x[good] /= np.linalg.norm(x[good], axis=1, keepdims=True)
    return x, good


def _entries(projections, dimensions: int):
    """projections: a broadcast of them, as they grow with the root of the number of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = projections.value.counting()
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                x, good = _unit(part.column(1), dimensions)
                names, copies = (np.array(part.column(c).to_pylist(), np.int64)[good] for c in (0, 2))
                x = x[good]
                if not len(x):
                    continue
                numbers, products = projections.value.ends(x)
                lists = counting.lists(numbers, products)[0]
                width = lists.shape[1]
                packed = [n.tobytes() + v.tobytes() + y.tobytes() for n, v, y in zip(numbers, products, x, strict=True)]
                at = np.repeat(np.arange(len(x)), width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists.ravel()), pa.array(names[at]), pa.array(copies[at]), pa.array(packed, pa.binary()).take(at)],
                    ["list", "vec", "copies", "packed"],
                )

    return run


def _whole(dimensions: int):
    """Entries for comparing all: one list, of which each vector is sent once for each block that its own meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good = _unit(batch.column(1), dimensions)
            names, copies = (batch.column(c).filter(pa.array(good)) for c in (0, 2))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(int(good.sum()), np.int64)), names, copies, pa.array([y.tobytes() for y in x[good]], pa.binary())], ["list", "vec", "copies", "packed"]
            )

    return run


def _pairs_of(values: np.ndarray, side: np.ndarray, window: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places whose values differ by the window at most; between the two sides if there are two."""
    order = np.argsort(values, kind="stable")
    end = np.searchsorted(values[order], values[order] + window, side="right")
    count = end - np.arange(len(order)) - 1
    left = np.repeat(np.arange(len(order)), count)
    right = left + 1 + np.arange(count.sum()) - np.repeat(np.append(0, np.cumsum(count)[:-1]), count)
    i, j = order[left], order[right]
    if side.any() and not side.all():
        apart = side[i] != side[j]
        i, j = i[apart], j[apart]
    return i, j


def _verify(counting: Counting | None, tables: int, dimensions: int, cosine: float):
    """Compares the vectors that meet in a list; without counting all of them."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        raw = np.frombuffer(b"".join(frame["packed"]), np.uint8).reshape(len(frame), -1)
        cut = (raw.shape[1] - 8 * dimensions) // 2
        x = np.ascontiguousarray(raw[:, 2 * cut :]).view(np.float64)
        if counting:
            numbers, products = (np.ascontiguousarray(raw[:, i * cut : (i + 1) * cut]).view(t).reshape(len(frame), tables, 2, -1) for i, t in enumerate((np.int32, np.float32)))
            own_lists, values = counting.lists(numbers, products)
        names, copies = frame["vec"].to_numpy(), frame["copies"].to_numpy()
        lists, sides, tasks = frame["list"].to_numpy(), frame["side"].to_numpy(), frame["task"].to_numpy()
        links = np.zeros(len(frame), np.int64)
        parent = np.arange(len(frame))
        edges: list[tuple[int, int]] = []

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        order = np.lexsort((lists, tasks))
        for rows in np.split(order, np.flatnonzero((np.diff(tasks[order]) != 0) | (np.diff(lists[order]) != 0)) + 1):
            own = lists[rows[0]]
            here = np.where(own_lists[rows] == own, values[rows], -np.inf).max(axis=1) if counting else np.zeros(len(rows))
            left, right = _pairs_of(here, sides[rows] > 0, counting.window * (1 + 1e-5) + 1e-5 if counting else 1.0)
            for k in range(0, len(left), AT_ONCE):
                i, j = rows[left[k : k + AT_ONCE]], rows[right[k : k + AT_ONCE]]
                near = np.empty(len(i))
                for q in range(0, len(i), 4000):
                    a, b = i[q : q + 4000], j[q : q + 4000]
                    passed = np.ones(len(a), bool)
                    if counting:
                        count, first = counting.collisions(numbers[a], products[a], numbers[b], products[b])
                        passed = (count >= counting.least) & (first == own)
                    near[q : q + 4000] = -1
                    near[q : q + 4000][passed] = np.einsum("ij,ij->i", x[a[passed]], x[b[passed]])
                hit = near >= cosine
                i, j = i[hit], j[hit]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    p, q = root(a), root(b)
                    if p != q:
                        parent[q] = p
                        edges.append((a, b))
        linked = np.flatnonzero(links)
        # numbers of 64 bits must not pass through floats, as they would in a column with nulls
        a = [names[x] for x, _ in edges] + names[linked].tolist()
        b = [names[x] for _, x in edges] + [None] * len(linked)
        return pd.DataFrame({"a": pd.array(a, "Int64"), "b": pd.array(b, "Int64"), "links": pd.array([0] * len(edges) + links[linked].tolist(), "Int64")})

    return run


def placed(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """entries with a task and a side: short lists share tasks; pairs of blocks of a long list have tasks of their own."""
    sizes = entries.groupBy("list").agg(F.count("*").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(1, int(total) // (4 * block))
    blocks = F.expr(f"cast((n + {block - 1}) div {block} as int)")
    sized = entries.join(sizes, "list").withColumn("blocks", blocks)
    own = F.expr("cast(pmod(xxhash64(vec), blocks) as int)")
    meets = F.explode(F.expr("transform(sequence(0, blocks - 1), o -> struct(least(own, o) as x, greatest(own, o) as y, cast(own > o as int) as side))"))
    cut = sized.where("blocks > 1").withColumn("own", own).withColumn("m", meets)
    return (
        sized.where("blocks = 1")
        .select(F.pmod(F.xxhash64("list"), F.lit(tasks)).alias("task"), F.lit(0).alias("side"), "list", "vec", "packed", "copies")
        .unionByName(cut.select(F.xxhash64("list", "m.x", "m.y").alias("task"), F.col("m.side").alias("side"), "list", "vec", "packed", "copies"))
    )


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """One row for each row of vectors: id, n_links, component_id, kept.

    Vectors link when their cosine in double precision is at least `cosine`; n_links counts a row's links, component_id is the
    smallest id that links reach, and a row is kept if that is its own id. Null vectors, zero ones, those with null or non-finite components
    and those of another length than most link with nothing. Equal vectors are handled as one and counted as many. A null id is never the smallest
    unless a component has no other, and is not kept. Rows that repeat an id are vectors of their own. No rows give no rows; other
    columns are not looked at. At cosines that no calibration serves, all pairs are compared, block by block, and none is missed.
    """
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    finite = F.expr("v IS NOT NULL AND forall(v, c -> coalesce(abs(c) < double('infinity'), false)) AND exists(v, c -> c != 0)")
    length = rows.where(finite).groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if length is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    dimensions = length[0]
    usable = finite & (F.size("v") == dimensions)
    keyed = rows.withColumn("vec", F.when(usable, F.xxhash64(F.transform("v", lambda c: c.cast("double") + F.lit(0.0)))))
    distinct = written(
        keyed.where("vec IS NOT NULL").groupBy("vec").agg(F.any_value("v").alias("v"), F.count("*").alias("copies"), F.min("id").alias("first")), "vectors"
    )
    n = distinct.count()
    sample = distinct.orderBy("vec").limit(CALIBRATED).select("v").toPandas()["v"]
    sample = np.array([np.asarray(v, float) for v in sample]) if len(sample) else np.zeros((0, dimensions))
    projections = calibrated(n, dimensions, cosine, sample / np.maximum(np.abs(sample).max(axis=1, keepdims=True, initial=0), 1e-300))
    if projections:
        shared = vectors.sparkSession.sparkContext.broadcast(projections)
        listed, verify = _entries(shared, dimensions), _verify(projections.counting(), len(projections.first), dimensions, cosine)
    else:
        listed, verify = _whole(dimensions), _verify(None, 0, dimensions, cosine)
    entries = written(distinct.select("vec", "v", "copies").mapInArrow(listed, "list long, vec long, copies long, packed binary"), "vector-lists")
    found = placed(entries).groupBy("task").applyInPandas(verify, "a long, b long, links long")
    found = written(found, "vector-links")
    linked = components(found.where("b IS NOT NULL"))
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    label = distinct.join(linked, F.col("vec") == F.col("node"), "left").withColumn("component", F.coalesce("component", "vec"))
    smallest = label.groupBy("component").agg(F.min("first").alias("component_id"))
    label = label.join(smallest, "component").join(counts, F.col("vec") == F.col("a"), "left")
    label = label.select("vec", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = keyed.select("id", "vec").join(label, "vec", "left")
    component = F.when(F.col("vec").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )

"""Pairs of similar texts without comparing all: an inverted index of pairs of characters, with counts that a ratio implies.

The ratio of two texts of a and b characters is 2 m / (a + b), where m characters match in blocks. Two neighbouring blocks have a character between them that does
not match, so there are at most a + b - 2 m + 1 blocks, and the texts have at least 3 m - (a + b) - 1 pairs of characters in common. A text of which c pairs must be
found again has one of them among any n - c + 1 of its n pairs, so it is enough to look up the rarest.

Where few texts have the same keys, a task holds them with their index (`best_held`), one row a text; else the index is a table of one row for each pair of each text.
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby
from math import ceil

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rare pairs by which a first, near enough partner is looked for, and texts that may hold such a pair.
FIRST, HOLDERS = 6, 1000
#: Texts of the same keys, and their characters, that a task holds at most; texts times asked texts that meet in one deal, about.
TEXTS, CHARS, DEAL = 2048, 1 << 21, 1 << 16


def common(a: str, b: str) -> int:
    """The length of the longest common subsequence, by the bits of a number: as many characters can match at most."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    open_ = every
    for c in b:
        if found := open_ & places.get(c, 0):
            open_ = (open_ + found | open_ - found) & every
    return len(a) - open_.bit_count()


def ratio_from(m: difflib.SequenceMatcher, least: float) -> float:
    """The ratio of a matcher's texts, 0 where it is below `least`."""
    if m.real_quick_ratio() < least or m.quick_ratio() < least or (m.a or m.b) and 2.0 * common(m.a, m.b) / (len(m.a) + len(m.b)) < least:
        return 0.0
    found = m.ratio()
    return found if found >= least else 0.0


def similarity(a: Column, b: Column, least: Column) -> Column:
    """The ratio of matching stretches of two texts, 0 where it is below `least`. Two empty texts are alike."""

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
        return pd.Series([ratio_from(difflib.SequenceMatcher(None, x, y), t) for x, y, t in zip(a, b, least, strict=True)], dtype=float)

    return ratio(a, b, least)


def pairs_of(text: Column) -> Column:
    """The pairs of neighbouring characters of a text, in order."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.zip_with(F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))), F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))), lambda x, y: F.concat(x, y))


def least_shared(length: Column, least: Column) -> Column:
    """Pairs that a text of `length` characters has in common with any that is alike at `least` or more; below 1 if there need not be any."""
    # the shortest partner makes the sum of lengths, and with it the bound, least
    total = length * 2.0 / (2.0 - least)
    return F.ceil((1.5 * least - 1.0) * total - 1.0 - 1e-9)


def indexed(texts: DataFrame, keys: list[str], id_col: str, text_col: str) -> DataFrame:
    """(keys, id, pair): the different pairs of each text. One row of it with a null pair is given for each text too."""
    found = F.concat(F.array_distinct(pairs_of(F.col(text_col))), F.array(F.lit(None).cast("string")))
    return texts.select(*keys, id_col, F.explode(found).alias("pair"))


def rarest(texts: DataFrame, index: DataFrame, keys: list[str], id_col: str, text_col: str) -> DataFrame:
    """(keys, id, pair, holders, turn): each pair of each text, as often as it stands there, by how many texts of the index hold it, from the rarest on."""
    holders = index.where("pair IS NOT NULL").groupBy(*keys, "pair").agg(F.count("*").alias("holders"))
    found = texts.select(*keys, id_col, F.explode(pairs_of(F.col(text_col))).alias("pair")).join(holders, [*keys, "pair"], "left").fillna(0, ["holders"])
    return found.withColumn("turn", F.row_number().over(Window.partitionBy(*keys, id_col).orderBy("holders", "pair")))


def looked_up(asked: DataFrame, ranked: DataFrame, index: DataFrame, keys: list[str], asked_id: str, index_id: str) -> DataFrame:
    """(keys, asked_id, index_id): what can be alike, each once. asked has the columns `size` in characters and `least` of each text to look up; those whose
    bound says nothing meet all texts of their keys."""
    bound = asked.select(*keys, asked_id, least_shared(F.col("size"), F.col("least")).alias("shared"), (F.col("size") - 1).alias("pairs"))
    some = ranked.join(bound.where("shared >= 1"), [*keys, asked_id]).where(F.col("turn") <= F.col("pairs") - F.col("shared") + 1)
    by_pair = some.where("holders > 0").select(*keys, asked_id, "pair").distinct().join(index, [*keys, "pair"]).select(*keys, asked_id, index_id)
    by_key = bound.where("shared < 1").select(*keys, asked_id).join(index.where("pair IS NULL").select(*keys, index_id), keys).select(*keys, asked_id, index_id)
    return by_pair.distinct().unionByName(by_key)


class Held:
    """Texts in order, with the index of their pairs: for each pair the set of its holders, as the bits of a number."""

    def __init__(self, texts: list[str]):
        self.texts, self.holders, self.matchers = texts, {}, {}
        self.pairs = [Counter(map("".join, zip(t, t[1:], strict=False))) for t in texts]
        for i, pairs in enumerate(self.pairs):
            for pair in pairs:
                self.holders[pair] = self.holders.get(pair, 0) | 1 << i

    def near(self, ranked: list[tuple[int, str, int]]) -> int | None:
        """The text that shares most of the first rare pairs."""
        shared, left = Counter(), FIRST
        for n, pair, times in ranked:
            if left and 1 <= n <= HOLDERS:
                shared.update(dict.fromkeys(bits(self.holders[pair]), min(times, left)))
                left -= min(times, left)
        return min(shared, key=lambda i: (-shared[i], i)) if shared else None

    def fits(self, asked: str, i: int, least: float) -> bool:
        a, b = len(asked), len(self.texts[i])
        return 2.0 * min(a, b) >= least * (a + b)

    def most(self, asked: str, own: Counter, i: int) -> float:
        """What the ratio can be at most, by the pairs in common."""
        size, other = len(asked) + len(self.texts[i]), self.pairs[i]
        return (sum(min(n, other[pair]) for pair, n in own.items() if pair in other) + size + 1.0) / (1.5 * size) if size else 1.0

    def ratio(self, asked: str, i: int, least: float) -> float:
        if i not in self.matchers:
            self.matchers[i] = difflib.SequenceMatcher(None, "", self.texts[i])
        self.matchers[i].set_seq1(asked)
        return ratio_from(self.matchers[i], least)

    def best(self, asked: str, threshold: float) -> tuple[int | None, float | None, int]:
        """The place and the ratio of the most similar text, from `threshold` on, the first of equal ones, and how many texts were candidates."""
        own = Counter(map("".join, zip(asked, asked[1:], strict=False)))
        ranked = sorted((self.holders.get(pair, 0).bit_count(), pair, times) for pair, times in own.items())
        known = {}
        if (i := self.near(ranked)) is not None and self.fits(asked, i, threshold):
            known[i] = self.ratio(asked, i, threshold)
        least = max(threshold, *known.values(), 0.0)
        shared = ceil((1.5 * least - 1.0) * (len(asked) * 2.0 / (2.0 - least)) - 1.0 - 1e-9)
        some = (1 << len(self.texts)) - 1 if shared < 1 else 0
        left = len(asked) - shared if shared >= 1 else 0
        for _, pair, times in ranked:
            if left <= 0:
                break
            some |= self.holders.get(pair, 0)
            left -= times
        found = [i for i in bits(some) if self.fits(asked, i, least)]
        at, best = None, 0.0
        # the likeliest come first, so that most of the others need no ratio
        for most, i in sorted(((self.most(asked, own, i), i) for i in found), key=lambda x: (-x[0], x[1])):
            if most < max(least, best) - 1e-6:
                break
            ratio = known[i] if i in known else self.ratio(asked, i, max(least, best))
            if ratio > best or at is not None and ratio == best and i < at:
                at, best = i, ratio
        return at, best if best else None, len(found)


def bits(n: int) -> Iterator[int]:
    while n:
        yield (n & -n).bit_length() - 1
        n &= n - 1


def best_held(asked: DataFrame, texts: DataFrame, sizes: DataFrame, keys: list[str], asked_id: str, asked_text: str, index_id: str, index_text: str, threshold: float) -> DataFrame:
    """(keys, asked_id, index_id, ratio, compared): of each asked text, the most similar of the texts of its keys, from `threshold` on, the first by id of equal
    ones, and the number of those that can be alike. sizes(keys, texts, asked) has how many there are, of keys of which a task can hold all texts; where many are asked, they are dealt
    out, and each deal meets all texts of its keys."""
    dealt = sizes.withColumn("deals", F.ceil(F.col("asked") * F.col("texts") / DEAL).cast("int"))
    none = lambda like, c: F.lit(None).cast(like.schema[c].dataType).alias(c)
    held = texts.join(dealt, keys).select(*keys, F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), none(asked, asked_id), index_id, F.col(index_text).alias("text"))
    meet = asked.join(dealt, keys).select(*keys, F.pmod(F.hash(asked_id), "deals").alias("deal"), asked_id, none(texts, index_id), F.col(asked_text).alias("text"))
    order = [*keys, "deal"]
    rows = held.unionByName(meet).repartition(*order).sortWithinPartitions(*order, F.col(index_id).asc_nulls_last())
    schema = T.StructType([*[T.StructField(k, rows.schema[k].dataType) for k in [*keys, asked_id, index_id]], T.StructField("ratio", T.DoubleType()), T.StructField("compared", T.LongType())])
    return rows.mapInArrow(_aligner(order, keys, asked_id, index_id, threshold), schema)


def _aligner(order: list[str], keys: list[str], asked_id: str, index_id: str, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def groups(table: pa.Table) -> list[list[int]]:
        named = list(zip(*[table[c].to_pylist() for c in order], strict=True))
        return [list(g) for _, g in groupby(range(len(named)), key=named.__getitem__)]

    def answers(table: pa.Table, found: list[list[int]]) -> Iterator[pa.RecordBatch]:
        text, asks = table["text"].to_pylist(), table[index_id].is_null().to_pylist()
        own, at, ratios, compared = [], [], [], []
        for group in found:
            lines = [i for i in group if not asks[i]]
            asked = group[len(lines) :]
            held = Held([text[i] for i in lines]) if asked else None
            for i in asked:
                best, ratio, n = held.best(text[i], threshold)
                own.append(i)
                at.append(None if best is None else lines[best])
                ratios.append(ratio)
                compared.append(n)
        own, at = pa.array(own, pa.int64()), pa.array(at, pa.int64())
        columns = {k: table[k].take(own) for k in [*keys, asked_id]} | {index_id: table[index_id].take(at), "ratio": pa.array(ratios, pa.float64()), "compared": pa.array(compared, pa.int64())}
        yield from pa.table(columns).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
            found = groups(table)
            if found:
                # the last group may go on in the next batch
                yield from answers(table, found[:-1])
                rest = table.slice(found[-1][0])
        if rest is not None:
            yield from answers(rest, groups(rest))

    return run

"""Similarity join of documents by the Jaccard similarity of their word n-grams: grouped prefix join.

Shingles are 64-bit hashes, made for a batch of texts at once. Documents with the same set of shingles are one class, and
classes with the same prefix and size are one group (Bouros, Ge, Mamoulis 2012). A class's prefix holds the first
|S| - ceil(t |S|) + 1 shingles of S in a global order, so that classes of similarity t share one; the order takes rare shingles first:

* Shingles of the sampled part of the hash space (all for small sets) are ordered by the number of classes that hold them, found by
  an exact count; the others follow by hash. Passages that many documents share thus come last, and prefixes hold what is rare.
* Shingles that a large share of all documents holds are found in the pass that makes the sets. What they count as is broadcast, so their
  holders need not meet in one task; any number does, as long as it is the same for all.
* A class whose prefix has only shingles of its own has no partner and leaves here, as most do.

Each list of groups that share a prefix shingle is handled in the family of its leader, the least group in it. Lists of one
leader share their members for the most part, so a set travels a few times and not once for each shingle of its prefix; families are not chained, so what
they hold stays near what one group shares. In a family group pairs are formed from the lists and filtered: a pair counts only where
its first common shingle leads to this family, so each is looked at once; its sizes must allow a link, and so must the places of that shingle in
both. Pairs that are left are expanded to their members, whose whole sets are compared. A large family is cut by size and hash into
blocks, and pairs of blocks are tasks; counts of links and a spanning set of them leave a task, and no pairs do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbooks.llm.shared import components, id_type, small_batches, written

#: Sets below SMALL are ordered by counts over the whole hash space; larger ones over a 2^SAMPLED-th of it.
SMALL, SAMPLED = 64, 2
#: Bytes of text that are shingled at once, and shingles whose classes are counted by one task, about.
CHUNK, COUNTED = 2 << 20, 250_000
#: Classes in a block and in a bin of small families; a class of more than UNIT shingles counts as several.
BLOCK, UNIT = 600, 512
#: A shingle is hot if at least HOT documents and a SHARE-th of all hold it; MOST_HOT are broadcast at most, and the rest are counted like others.
HOT, SHARE, MOST_HOT = 1000, 2000, 1 << 20

_rng = np.random.default_rng(20)
_CHAR = _rng.integers(1 << 62, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHAR[65:91] = _CHAR[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words in the bytes, and where each begins; A-Z count as a-z."""
    space = np.concatenate([[True], _IS_SPACE[raw], [True]])
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:])
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    # a polynomial in the step over random numbers for the bytes; dividing by the step's power makes it start at the word
    powers = np.empty(len(raw) + 1, np.uint64)
    powers[0] = 1
    powers[1:] = _STEP
    np.multiply.accumulate(powers, out=powers)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_CHAR[raw] * powers[:-1], dtype=np.uint64)])
    back = np.empty(len(raw) + 1, np.uint64)
    back[0] = 1
    back[1:] = _BACK
    np.multiply.accumulate(back, out=back)
    return _mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)), starts


def shingle_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct n-word shingles; with fewer words, of the whole sequence."""
    begin = 0
    while begin < len(texts):
        raws, held = [], 0
        while begin + len(raws) < len(texts) and (not raws or held < CHUNK):
            raws.append((texts[begin + len(raws)] or "").encode())
            held += len(raws[-1]) + 1
        begin += len(raws)
        words, starts = word_hashes(np.frombuffer(b" ".join(raws), np.uint8))
        limits = np.cumsum([0, *[len(r) + 1 for r in raws]])
        first = np.searchsorted(starts, limits)
        count = max(0, len(words) - n + 1)
        hashed = np.zeros(count, np.uint64)
        for i in range(n):
            hashed = _mixed(hashed + words[i : i + count] + np.uint64(i + 1))
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= n:
                yield np.unique(hashed[a : b - n + 1])
            elif b > a:
                own = np.zeros(1, np.uint64)
                for i in range(b - a):
                    own = _mixed(own + words[a + i : a + i + 1] + np.uint64(i + 1))
                yield own
            else:
                yield hashed[:0]


def fingerprint(shingles: np.ndarray) -> int:
    """A set's 64-bit fingerprint."""
    with np.errstate(over="ignore"):
        x = _mixed(shingles + np.uint64(77)).sum(dtype=np.uint64) + _STEP * np.uint64(len(shingles))
        return int(_mixed(np.array([x], np.uint64)).view(np.int64)[0])


def needed(a: np.ndarray | int, b: np.ndarray | int, percent: int):
    """The least intersection of sets of sizes a and b whose similarity is `percent` / 100."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def _sets(n: int, kind: pa.DataType):
    """(id, key, n, class) of each row; then, with n = -1, (count, shingle) of those that several classes of a chunk of rows hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: pa.Array, keys: pa.Array, sizes: pa.Array, prints: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, keys, sizes, prints], ["id", "key", "n", "class"])

        held: dict[int, np.ndarray] = {}
        size = 0

        def several() -> pa.RecordBatch:
            shingles, counts = np.unique(np.concatenate([*held.values(), np.zeros(0, np.uint64)]), return_counts=True)
            shingles, counts = shingles[counts > 1], counts[counts > 1]
            return out(pa.nulls(len(counts), kind), pa.array(counts, pa.int64()), pa.array(np.full(len(counts), -1), pa.int64()), pa.array(shingles.view(np.int64)))

        for batch in batches:
            rows = []
            for s in shingle_sets(batch.column(2).to_pylist(), n):
                rows.append((len(s), fingerprint(s)) if len(s) else (0, None))
                if len(s) and rows[-1][1] not in held:
                    held[rows[-1][1]] = s
                    size += len(s)
                if size > COUNTED:
                    yield several()
                    held.clear()
                    size = 0
            sizes, prints = list(zip(*rows, strict=True)) or [[], []]
            yield out(batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()))
        if held:
            yield several()

    return run


def _orders(size: int, percent: int) -> list[int]:
    """The orders that a set takes part in: 0 for small sets, 1 for large ones, both near the border."""
    return [0] * (size * percent <= SMALL * 100) + [1] * (size >= SMALL)


def _ordered_part(shingles: np.ndarray, order: int, percent: int) -> tuple[np.ndarray, int]:
    """The shingles whose classes are counted, and how many of them are from the sampled part."""
    if order == 0:
        return shingles, len(shingles)
    inside = int(np.searchsorted(shingles, np.uint64(1 << (64 - SAMPLED))))
    return shingles[: max(inside, min(len(shingles), prefix_length(len(shingles), percent)))], inside


def _postings(n: int, percent: int, buckets: int, hot):
    """(bucket, holders): holders packs (shingle, class, size, counted, order) of one bucket, 16-bit numbers last. Hot shingles are in
    buckets below 0, dealt by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value[0]
        met: set[int] = set()
        for batch in batches:
            parts = []
            for s in shingle_sets(batch.column(0).to_pylist(), n):
                if not len(s) or (own := fingerprint(s)) in met:
                    continue
                met.add(own)
                for order in _orders(len(s), percent):
                    held, _ = _ordered_part(s, order, percent)
                    parts.append((held, own, len(s), len(held), order))
            if len(met) > 1 << 18:
                met.clear()
            if not parts:
                continue
            lengths = [len(p[0]) for p in parts]
            hashes = np.concatenate([p[0] for p in parts])
            table = np.empty((len(hashes), 3), np.int64)
            table[:, 0] = hashes.view(np.int64)
            table[:, 1] = np.repeat(np.array([p[1] for p in parts], np.int64), lengths)
            table[:, 2] = np.repeat(np.array([(p[2] << 32) | (p[3] << 1) | p[4] for p in parts], np.int64), lengths)
            bucket = ((hashes * _STEP) >> np.uint64(40)).astype(np.int64) % buckets
            often = _is_in(hashes, known)
            bucket[often] = -1 - table[often, 1] % buckets
            at = np.argsort(bucket, kind="stable")
            table, bucket = table[at], bucket[at]
            names, first = np.unique(bucket, return_index=True)
            blobs = [x.tobytes() for x in np.split(table, first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "holders"])

    return run


def _is_in(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def _counted(hot):
    """One bucket: the shingles that more than one class holds, with the number of classes; hot ones with the number that is known."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        table = np.frombuffer(b"".join(frame["holders"]), np.int64).reshape(-1, 3)
        order = table[:, 2] & 1
        table = table[np.lexsort((table[:, 1], order, table[:, 0]))]
        new = np.ones(len(table), bool)
        new[1:] = (table[1:] != table[:-1]).any(axis=1)  # a class is met once, however many tasks sent it
        table = table[new]
        if frame["bucket"].iloc[0] < 0:
            known, counts = hot.value
            count = counts[np.searchsorted(known, table[:, 0].view(np.uint64))]
        else:
            order = table[:, 2] & 1
            start = np.ones(len(table), bool)
            start[1:] = (table[1:, 0] != table[:-1, 0]) | (order[1:] != order[:-1])
            group = np.cumsum(start) - 1
            count = np.bincount(group)[group] if len(table) else group
            table, count = table[count > 1], count[count > 1]
        return pd.DataFrame(
            {
                "class": table[:, 1],
                "ord": (table[:, 2] & 1).astype(np.int32),
                "n": table[:, 2] >> 32,
                "held": (table[:, 2] >> 1) & 0x7FFFFFFF,
                "shingle": table[:, 0],
                "holders": count,
            }
        )

    return run


def classes(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, key, n, class) of each row: the size and the fingerprint of its set; key is a hash of the text. Rows with n = -1 tell of
    shingles that several documents hold: class is the shingle, key the number."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = to_arrow_type(rows.schema["id"].dataType)
    return rows.mapInArrow(_sets(n, kind), f"id {id_type(rows, 'id')}, key long, n long, class long")


def hot_shingles(sets: DataFrame, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """The hot shingles, sorted, and about how many documents hold each; MOST_HOT at most, of 16 bytes each."""
    counts = sets.where("n = -1").groupBy("class").agg(F.sum("key").alias("n")).where(F.col("n") >= max(HOT, documents // SHARE))
    found = counts.orderBy(F.desc("n"), "class").limit(MOST_HOT).toPandas()
    shingles = found["class"].to_numpy(np.int64).view(np.uint64)
    at = np.argsort(shingles)
    return shingles[at], found["n"].to_numpy(np.int64)[at]


def prefixes(docs: DataFrame, text_col: str, n: int, percent: int, shingles: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(class, n, ord, before, prefix): the part of each class's prefix that other classes hold too, and how many of its shingles are sure to
    come before that; classes without such a part are absent."""
    buckets = max(16, -(-shingles // COUNTED))
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    packed = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_postings(n, percent, buckets, shared), "bucket long, holders binary")
    schema = "class long, ord int, n long, held long, shingle long, holders long"
    common = packed.groupBy("bucket").applyInPandas(_counted(shared), schema)
    # from the sampled part or not comes first in the order, then the count there, then the hash as an unsigned number
    outside = F.when((F.col("ord") == 1) & (F.shiftrightunsigned("shingle", 64 - SAMPLED) != 0), 1).otherwise(0)
    often = F.when(outside == 1, 0).otherwise(F.col("holders"))
    entry = F.struct(outside.alias("outside"), often.alias("often"), (F.col("shingle").bitwiseXOR(F.lit(-(1 << 63)))).alias("at"), "shingle")
    per = common.groupBy("class", "ord", "n", "held").agg(F.array_sort(F.collect_list(entry)).alias("common"))
    length = F.expr(f"cast(n - ({percent} * n + 99) div 100 + 1 as int)")
    # shingles of the class alone come before the common ones, so they take their places in the prefix
    alone = F.col("held").cast("int") - F.size("common")
    per = per.withColumn("room", (F.least(length, F.col("held").cast("int")) - alone).cast("int")).where("room > 0")
    before = F.when((F.col("ord") == 0) | (F.col("held") > length), alone).otherwise(0).cast("int")
    return per.select("class", "n", "ord", before.alias("before"), F.expr("transform(slice(common, 1, greatest(room, 0)), x -> x.shingle)").alias("prefix"))


def grouped_families(prefix: DataFrame) -> DataFrame:
    """(ord, family, class, n, group, before, places, shingles, leaders): each class in the families of its group's lists.

    Of the prefix only shingles whose lists have several classes are left, with their places in it and the leaders of their lists.
    """
    groups = prefix.groupBy("ord", "n", "prefix").agg(F.min("class").alias("group"), F.min("before").alias("before"), F.count("*").alias("members"))
    listed = groups.select("ord", "group", "n", "members", F.posexplode("prefix").alias("place", "shingle"))
    lists = listed.groupBy("ord", "shingle").agg(F.min("group").alias("leader"), F.sum("members").alias("held")).where("held > 1").drop("held")
    part = F.struct("place", "shingle", "leader")
    lead = listed.join(lists, ["ord", "shingle"]).groupBy("ord", "group", "n").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    lead = lead.select("ord", "group", "n", *[F.expr(f"transform(parts, x -> x.{c})").alias(f"{c}s") for c in ("place", "shingle", "leader")])
    members = prefix.drop("before").join(groups.drop("members"), ["ord", "n", "prefix"]).drop("prefix").join(lead, ["ord", "group", "n"])
    return members.withColumn("family", F.explode(F.array_distinct("leaders")))


def group_pairs(entries: pd.DataFrame, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each group of a task the rows of its members, and the rows of those of groups whose pair with it passes the filters, itself included
    if it has several members. Each pair comes once. Rows must be in order of family."""
    key = ["ord", "family", "group", "side"]
    number = entries.groupby(key, sort=False).ngroup().to_numpy()
    by_group = np.argsort(number, kind="stable")
    rows = np.split(by_group, np.flatnonzero(np.diff(number[by_group])) + 1)
    one = np.array([r[0] for r in rows])
    ords, family, side, size, before = (entries[c].to_numpy()[one] for c in ("ord", "family", "side", "n", "before"))
    lengths = np.array([len(entries["shingles"].iat[k]) for k in one])
    flat = {c: np.concatenate([entries[c].iat[k] for k in one]).astype(np.int64) for c in ("shingles", "leaders", "places")}
    owner = np.repeat(np.arange(len(one)), lengths)
    # a shingle is met only within its family
    salted = _mixed(flat["shingles"].view(np.uint64) ^ _mixed(family.astype(np.int64).view(np.uint64) * np.uint64(2) + ords.astype(np.uint64))[owner])
    at = np.argsort(salted, kind="stable")
    start = np.ones(len(at), bool)
    start[1:] = salted[at][1:] != salted[at][:-1]
    token = np.empty(len(at), np.int64)
    token[at] = np.cumsum(start) - 1
    first = np.append(np.flatnonzero(start), len(at))
    bounds = np.append(0, np.cumsum(lengths))
    small = size * percent <= SMALL * 100
    for i in range(len(one)):
        mine = np.arange(bounds[i], bounds[i + 1])
        low, count = first[token[mine]], first[token[mine] + 1] - first[token[mine]]
        places = at[np.repeat(low - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())]
        j, met = np.unique(owner[places], return_index=True)
        there, here = places[met], np.repeat(mine, count)[met]
        passes = (j > i) | ((j == i) & (len(rows[i]) > 1) & (side[i] < 0))
        passes &= (side[j] != side[i]) | (side[j] < 0)
        passes &= flat["leaders"][here] == family[i]
        passes &= (ords[i] == 0) | ~(small[i] & small[j])  # both are in the other order too
        passes &= 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
        most = 1 + np.minimum(size[i] - before[i] - flat["places"][here], size[j] - before[j] - flat["places"][there]) - 1
        passes &= most >= needed(size[i], size[j], percent)
        if passes.any():
            yield rows[i], np.concatenate([rows[k] for k in j[passes]])


def verified_links(entries: pd.DataFrame, sets: list[np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The links of a task, as pairs of rows: members of group pairs that pass the filters, whose sets are compared exactly."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    family = _mixed(entries["family"].to_numpy(np.int64).view(np.uint64) * np.uint64(2) + entries["ord"].to_numpy(np.int64).view(np.uint64))
    flat = np.concatenate(sets) ^ family[owner]
    at = np.argsort(flat, kind="stable")
    start = np.ones(len(flat), bool)
    start[1:] = flat[at][1:] != flat[at][:-1]
    token = np.empty(len(flat), np.int64)
    token[at] = np.cumsum(start) - 1
    first = np.append(np.flatnonzero(start), len(flat))
    owners = owner[at]
    bounds = np.append(0, np.cumsum(sizes))
    order = np.empty(len(sets), np.int64)
    for own, others in group_pairs(entries, percent):
        order[own] = np.arange(len(own))
        for i in own.tolist():
            mine = token[bounds[i] : bounds[i + 1]]
            low, count = first[mine], first[mine + 1] - first[mine]
            low, count = low[count > 1], count[count > 1]
            if not len(low):
                continue
            places = np.repeat(low - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
            common = np.bincount(owners[places], minlength=len(sets))[others]
            hit = others[100 * common >= percent * (sizes[i] + sizes[others] - common)]
            # of pairs within the group the later row is taken
            hit = hit[~np.isin(hit, own) | (order[hit] > order[i])] if len(own) > 1 else hit
            yield np.full(len(hit), i), hit


def _verify(percent: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["ord", "family", "class"]).sort_values(["ord", "family"], kind="stable", ignore_index=True)
        names, number = np.unique(frame["class"].to_numpy(np.int64), return_inverse=True)
        copies = frame["copies"].to_numpy(np.int64)
        links = np.zeros(len(names), np.int64)
        parent = list(range(len(names)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        edges = []
        for i, j in verified_links(frame, [np.frombuffer(x, np.uint64) for x in frame["set"]], percent):
            np.add.at(links, number[i], copies[j])
            np.add.at(links, number[j], copies[i])
            for a, b in zip(number[i].tolist(), number[j].tolist(), strict=True):
                if (p := root(a)) != (q := root(b)):
                    parent[q] = p
                    edges.append((a, b))
        linked = np.flatnonzero(links)
        a = [names[x] for x, _ in edges] + names[linked].tolist()
        b = [names[x] for _, x in edges] + [None] * len(linked)
        return pd.DataFrame({"a": pd.array(a, "Int64"), "b": pd.array(b, "Int64"), "links": pd.array([0] * len(edges) + links[linked].tolist(), "Int64")})

    return run


def _expand(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                sets = [s.tobytes() for s in shingle_sets(part.column(2).to_pylist(), n)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.binary())], ["class", "copies", "set"])

    return run


def tasks_of(members: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """members with (task, side): each pair of a family whose sizes allow a link meets in one task, of two blocks at most.

    Small families share bins; there, and in a block by itself, side is -1. A larger family is cut into blocks by size band and hash;
    two blocks of one band or of neighbouring bands are the sides 0 and 1 of a task, whose pairs are between the sides.
    """
    cost = F.lit(1) + F.expr(f"n div {UNIT}")
    per = members.groupBy("ord", "family").agg(F.count("*").alias("members"), F.sum(cost).alias("cost")).where("members > 1").drop("members")
    per = written(per, "jaccard-family-sizes")
    total = per.agg(F.coalesce(F.sum("cost"), F.lit(0))).first()[0]
    bins = max(1, int(total) // block)
    band = F.floor(F.log("n") / float(-np.log(percent / 100)) + 1e-9).cast("int")
    placed = members.join(per, ["ord", "family"]).withColumn("band", band)
    own = [placed[c] for c in members.columns]
    bin_ = F.concat(F.lit("bin-"), F.pmod(F.xxhash64("ord", "family"), F.lit(bins)))
    small = placed.where(F.col("cost") <= block).select(bin_.alias("task"), F.lit(-1).alias("side"), *own)
    large = placed.where(F.col("cost") > block).drop("cost")
    held = large.groupBy("ord", "family", "band").agg(F.expr(f"cast((sum(1 + n div {UNIT}) + {block - 1}) div {block} as int)").alias("blocks"))
    held = written(held, "jaccard-blocks")
    around = held.select("ord", "family", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = held.select("ord", "family", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    keys = ["ord", "family", "band"]
    large = large.join(held, keys).join(around, keys, "left").join(below, keys, "left").withColumn("own", F.expr("cast(pmod(xxhash64(class), blocks) as int)"))

    def meets(last: str, first_band: str, first: str, second_band: str, second: str, side: str) -> str:
        name = f"concat_ws('-', ord, family, {first_band}, {first}, {second_band}, {second})"
        return f"transform(sequence(0, greatest(0, {last} - 1)), o -> if(o < {last}, struct({name} AS task, {side} AS side), null))"

    same_band = meets("blocks", "band", "least(own, o)", "band", "greatest(own, o)", "if(own = o, -1, if(own < o, 0, 1))")
    up = meets("coalesce(above, 0)", "band", "own", "band + 1", "o", "0")
    down = meets("coalesce(below, 0)", "band - 1", "o", "band", "own", "1")
    met = F.explode(F.array_compact(F.expr(f"concat({same_band}, {up}, {down})"))).alias("met")
    return small.unionByName(large.select(met, *members.columns).select("met.task", "met.side", *members.columns))


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, text_key: bool = False, block: int = BLOCK
) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id, n_links, and with text_key the text's xxhash64, which tells rows of one id apart.

    Words are runs of anything but white space, with A-Z lower-cased; a document's set is its distinct n-word shingles, or with fewer
    words the whole sequence as one. Two documents link when 100 * intersection >= percent * union; n_links counts a row's links, component_id is the
    smallest id that links reach, the document itself included. Documents without words, and null texts, have no shingles and link with nothing. A null id
    is never the smallest unless a component has no other; such a row still links others. Rows that repeat an id are documents
    of their own, of one component if their texts link. No rows give no rows; other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    found = written(classes(docs, id_col, text_col, n), "jaccard-sets")
    sets = found.where("n >= 0")
    known = sets.where("n > 0")
    part = F.when(F.col("n") < SMALL, F.col("n")).otherwise(F.shiftright("n", SAMPLED))
    counted, rows = known.agg(F.coalesce(F.sum(part), F.lit(0)), F.count("*")).first()
    prefix = written(prefixes(docs, text_col, n, percent, int(counted), hot_shingles(found, rows)), "jaccard-prefixes")
    families = written(grouped_families(prefix), "jaccard-families")
    tasks = written(tasks_of(families, percent, block), "jaccard-tasks")
    # one row of each class in a task carries its text to where the class is verified
    per_class = known.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "key")).alias("row"), F.count("*").alias("copies"))
    bearers = tasks.select("class").distinct().join(per_class, "class").select("class", "row.id", "row.key", "copies")
    texts = docs.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("k"), F.col(text_col).cast("string").alias("text"))
    carried = texts.join(bearers, (F.col("k") == F.col("key")) & F.col("i").eqNullSafe(F.col("id"))).select("class", "copies", "text")
    whole = carried.mapInArrow(_expand(n), "class long, copies long, set binary")
    links = written(tasks.join(whole, "class").groupBy("task").applyInPandas(_verify(percent), "a long, b long, links long"), "jaccard-links")
    linked = written(components(links.where("b IS NOT NULL")), "jaccard-components")
    counts = links.where("b IS NULL").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    first = known.groupBy("class").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    label = first.join(linked, F.col("class") == F.col("node"), "left").withColumn("component", F.coalesce("component", "class"))
    smallest = label.groupBy("component").agg(F.min("first").alias("component_id"))
    label = label.join(smallest, "component").join(counts, "class", "left")
    label = label.select("class", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    out = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links")]
    return sets.join(label, "class", "left").select(*out, *[F.col("key").alias("text_key")] * text_key)

"""The stages of corpus_pipeline against brute force on a small corpus with planted cases, and on awkward rows."""

import random
import re

import pytest

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice(["ba", "ce", "di", "fo", "gu", "ha"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def near(rng, text):
    w = text.split()
    w[rng.randrange(len(w))] = "other"
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    rows, labels, toxic = [], [], set()
    for i in range(240):
        t = prose(rng, rng.randrange(60, 160)).split()
        if i % 4 == 0:
            toxic.add(i)
            for _ in range(6):
                t[rng.randrange(len(t))] = rng.choice(["zuxword", "zuxperson", "zuxthing"])
        rows.append((i, " ".join(t), "en", f"s{i % 3}", 1))
        labels.append((i, 1, int(i % 4 == 0)))
    clean = [r for r in rows if r[0] % 4]
    rows += [(1000 + k, clean[k][1].replace(" ", "  "), "en", "s1", 1) for k in range(10)]
    rows += [(2000 + k, near(rng, clean[20 + k][1]), "fr", "s2", 1) for k in range(10)]
    rows += [(3000, None, None, None, None), (3001, "", "en", "s0", 0), (3002, " \n", None, "s0", 2), (None, prose(rng, 30), "en", None, 1), (3003, "one", "en", "s1", 3)]
    rows += [(3003, "one", "en", "s1", 3)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, toxic


def staged(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in cp.STAGES:
        docs = cp.written(stage(spark, docs, folder), "test-stage")
        out.append(docs)
    return out


def key(r):
    return (str(r.doc_id), str(r.text), str(r.source))


def test_stages(spark, corpus):
    folder, rows, toxic = corpus
    out = staged(spark, folder)
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    assert all(df.columns == columns for df in out[:-1])

    kept = {r.doc_id for r in out[0].collect()}
    assert len(toxic & kept) <= len(toxic) * 0.1
    assert len([r for r in rows if r[0] not in toxic and r[0] in kept]) >= 0.97 * len([r for r in rows if r[0] not in toxic])

    groups = {}
    for r in out[0].collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), []).append(r.doc_id)
    want = sorted(str(min((i for i in ids if i is not None), default=None)) for ids in groups.values())
    assert sorted(str(r.doc_id) for r in out[1].collect()) == want

    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    docs = [(r.doc_id, grams(r.text)) for r in out[1].collect()]
    gone = set()
    for i, a in docs:
        for j, b in docs:
            if i is not None and j is not None and j < i and a and 100 * len(a & b) >= 80 * len(a | b):
                gone.add(i)
    assert {i for i in gone} == {i for i, _ in docs} - {r.doc_id for r in out[2].collect()}
    assert {2000 + k for k in range(10)} & {r.doc_id for r in out[2].collect()} == set()

    sizes, taken = {}, {}
    for r in out[2].collect():
        sizes[r.doc_id] = len((r.text or "").split())
    for r in out[3].collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert max(taken.values()) <= 3 and all(sizes[i] > 0 for i in taken)
    total, mixed = sum(sizes.values()), sum(sizes[i] * n for i, n in taken.items())
    assert abs(mixed - total) < 0.2 * total

    encoded = out[4].collect()
    assert len(encoded) == sum(taken.values()) and all(r.n_tokens > 0 and len(r.decoded_sha256) == 64 for r in encoded)


def test_run_is_the_stages(spark, corpus):
    folder, _, _ = corpus
    want = sorted((str(r.doc_id), r.ids_sha256) for r in staged(spark, folder)[-1].collect())
    assert sorted((str(r.doc_id), r.ids_sha256) for r in cp.run(spark, folder).collect()) == want


def test_stages_with_clashing_columns(spark, corpus):
    """Further columns whose names the operators use themselves come through, and change no decision."""
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id IS NULL OR doc_id % 3 = 1 OR doc_id >= 1000")
    names = "i s z id key size copies row sha place gone shown mixed kept score component_id text_key bucket class n".split()
    more = docs.selectExpr("*", *[f"'x' AS `{c}`" for c in names])
    for _, stage in cp.STAGES[:-1]:
        docs, more = (cp.written(stage(spark, x, folder), "clash") for x in (docs, more))
        assert more.columns == [*docs.columns, *names]
        assert sorted(map(key, more.collect())) == sorted(map(key, docs.collect()))
    assert cp.STAGES[-1][1](spark, more, folder).count() == docs.count()


def test_mixing_by_hand(spark, corpus):
    """The mixing stage takes each document as often as the schedule, worked out by hand, takes the block of its first word."""
    import hashlib

    folder, _, _ = corpus
    docs = [r for r in spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 1000").collect()]
    size = {r.doc_id: len(r.text.split()) for r in docs}
    sources = sorted({r.source for r in docs})
    total = {s: sum(size[r.doc_id] for r in docs if r.source == s) for s in sources}
    target = {s: sum(total.values()) * w / 8 for s, w in zip(sources, (5, 2, 1), strict=True)}
    assert all(target[s] <= 3 * total[s] for s in sources)
    blocks = {s: max(-(-total[s] // 256), min(total[s], 64)) for s in sources}
    slots, ends, c = {s: target[s] * blocks[s] / total[s] for s in sources}, {}, 0.0
    whole = sum(slots.values())
    for s in sources:
        c += slots[s]
        ends[s] = int(c / whole * 2**32)
    ends[sources[-1]] = 2**32
    taken = {s: [0] * blocks[s] for s in sources}
    turn = dict.fromkeys(sources, 0)
    for i in range(int(whole + 0.5)):
        point = (i + 1) * 2654435769 % 2**32
        s = next(s for s in sources if point < ends[s])
        if turn[s] < 3 * blocks[s]:
            taken[s][turn[s] % blocks[s]] += 1
        turn[s] += 1
    want = {}
    for s in sources:
        at, short, more = 0, total[s] // blocks[s], total[s] % blocks[s]
        starts = [b * short + min(b, more) for b in range(blocks[s])]
        for r in sorted((r for r in docs if r.source == s), key=lambda r: hashlib.md5(str(r.doc_id).encode()).hexdigest()):
            if n := taken[s][max(b for b in range(blocks[s]) if starts[b] <= at)]:
                want[r.doc_id] = n
            at += size[r.doc_id]
    got = {}
    for r in cp.mix_sources(spark, spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 1000"), folder).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == want


def test_empty(spark, corpus, tmp_path):
    folder, _, _ = corpus
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0

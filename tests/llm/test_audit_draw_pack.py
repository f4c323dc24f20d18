"""The operators of source divergence, importance resampling and packing against brute force, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkbooks.llm import divergence, importance, packing
from sparkbooks.llm.queries import word_file

SCHEMA = "doc_id long, text string, lang string, source string, ordinal long, n long, rank int, id string, key long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 1, 2, 3, "x", 4) for i, t, lang, source in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6))) for _ in range(80)]

    def text(n):
        return " ".join(rng.choice(vocabulary).upper() if rng.random() < 0.1 else rng.choice(vocabulary) for _ in range(n))

    found = [(i, text(rng.randrange(0, 90)), rng.choice(["en", "de", None]), rng.choice(["a", "B", "ß", "c", None])) for i in range(160)]
    found += [(500, text(20_000), "en", "a"), (501, "x" * 50_000, "en", "a"), (502, None, "en", "rare"), (503, "", "fr", "a"), (504, "1 2 , .", "fr", "b")]
    found += [(7, found[7][1], "en", "a")] * 3 + [(None, text(40), "en", "a"), (None, None, None, None), (505, "K İ ß ǅ 漢字 don't", "en", "a")]
    return found


def terms_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)


def audited(rows, least, top, more=5):
    docs = [(lang or "", source or "", Counter(terms_of(text))) for _, text, lang, source in rows]
    held = Counter((lang, t) for lang, _, c in docs for t in c)
    kept = {lang: sorted(t for (at, t), n in held.items() if at == lang and n >= least) for lang, _, _ in docs}
    counts = {}
    for lang, source, c in docs:
        own, whole = counts.setdefault((lang, source), Counter()), counts.setdefault((lang, None), Counter())
        for t in kept[lang]:
            own[t] += c[t]
            whole[t] += c[t]
    p = {}
    for (lang, source), c in counts.items():
        total = sum(c.values()) + more * len(kept[lang])
        p[lang, source] = {t: 1 + 10**9 * (c[t] + more) // total for t in kept[lang]}
    out = []
    for lang, source in counts:
        if source is None:
            continue
        own = p[lang, source]
        pairs = [(other, sum(abs(own[t] - p[lang, other][t]) for t in own)) for at, other in counts if at == lang and other not in (None, source)]
        found = [(t, own[t] - p[lang, None][t]) for t in own if counts[lang, source][t] and own[t] > p[lang, None][t]]
        for part, items, most in (("pair", pairs, 10**9), ("term", found, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(items[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_divergence(spark, rows, monkeypatch, small):
    if small:  # many transducers, rounds, blocks and tiles; counts handed on often
        for name, value in {"TERMS": 7, "AT_ONCE_BYTES": 3000, "BLOCK": 4, "TILE": 2, "HELD": 50, "SLICE": 100}.items():
            monkeypatch.setattr(divergence, name, value)
    got = [tuple(r) for r in divergence.audit(documents(spark, rows).repartition(5), least=20, top=6).collect()]
    assert sorted(got) == audited(rows, 20, 6)
    assert any(r[2] == "term" for r in got) and any(r[4] == 0 for r in got)


def test_divergence_of_nothing(spark, rows):
    assert divergence.audit(documents(spark, [])).collect() == []
    got = divergence.audit(documents(spark, rows), least=1000).collect()
    assert got and all(r.part == "pair" and r.value == 0 for r in got)


def test_transducer():
    rng = random.Random(3)
    words = sorted({bytes(rng.choice(b"ab\xc3\xa9") for _ in range(rng.randrange(1, 9))) for _ in range(400)})
    machine = divergence.Transducer.read(divergence.Transducer(words).packed())
    assert machine.ordinals(words).tolist() == list(range(len(words)))
    others = [w + b"q" for w in words[:50]] + [w[:-1] for w in words if w[:-1] not in words] + [b"", b"zz"]
    assert set(machine.ordinals(others).tolist()) == {-1}
    # minimal: as many states as there are different sets of endings
    endings = {frozenset(w[len(b) :] for w in words if w.startswith(b)) for b in {w[:k] for w in words for k in range(len(w) + 1)}}
    assert len(machine.final) == len(endings)


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def buckets_of(text, n):
    w = words_of(text)
    return [zlib.crc32(f.encode()) % n for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def drawn(rows, target, percent, least, buckets):
    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for counts, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            np.add.at(counts, buckets_of(text, buckets), 1)
    gain = [math.floor(1000 * math.log((b + 1.0) * (s.sum() + buckets) / ((a + 1.0) * (t.sum() + buckets)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    out = []
    for key, text, *_ in rows:
        found = buckets_of(text, buckets)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words_of(text)) >= least))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {}
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        rank.setdefault(r[:4], []).append(k)
    return sorted(((*r[:4], rank[r[:4]].pop(0) if rank.get(r[:4]) else None) for r in out), key=str)


@pytest.mark.parametrize("percent", [25, 100, 0])
def test_importance(spark, rows, monkeypatch, percent):
    monkeypatch.setattr(importance, "PIVOTS", 3)
    target = [rows[3][1], rows[4][1], None, "", "abc ab ABC"]
    got = importance.resample(documents(spark, rows).repartition(5), spark.createDataFrame([(x,) for x in target], "text string"), percent=percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == drawn(rows, target, percent, 20, 10_000)


def test_importance_of_nothing(spark, rows):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(documents(spark, []), none).collect() == []
    got = importance.resample(documents(spark, rows), none).collect()
    assert sorted((tuple(r) for r in got), key=str) == drawn(rows, [], 25, 20, 10_000)


def test_importance_repeats(spark):
    """One row repeated makes up most of the table: just as many of its copies are drawn as have a place."""
    rows = [(1, "a b " * 12, None, None)] * 60 + [(i, f"c{i} d " * 12, None, None) for i in range(2, 22)]
    got = importance.resample(documents(spark, rows).repartition(4), spark.createDataFrame([("a b",)], "text string"), percent=50).collect()
    assert sorted((tuple(r) for r in got), key=str) == drawn(rows, ["a b"], 50, 20, 10_000)
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 41))


def test_joined_crc():
    rng = random.Random(4)
    parts = [(rng.randbytes(rng.randrange(0, 9)), rng.randbytes(rng.choice([0, 1, 2, 5, 31, 70_000]))) for _ in range(60)]
    left, right = (np.array([zlib.crc32(p[k]) for p in parts], np.uint32) for k in (0, 1))
    got = importance.joined_crc(left, right, np.array([len(b) for _, b in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


def test_features_in_parts(monkeypatch):
    monkeypatch.setattr(importance, "AT_ONCE", 40)
    text = " ".join(f"w{i % 17}x" for i in range(300)) + " " + "y" * 200 + " end"
    got = np.concatenate(list(importance.Features(1000).of(text.encode())))
    assert Counter(got.tolist()) == Counter(buckets_of(text, 1000))


def unpacked(got, texts):
    """Checks that each id of each row lies in one piece; padding and number of ids."""
    import tokenizers

    t = tokenizers.Tokenizer.from_file(word_file())
    want = Counter()
    for key, text in texts:
        want[key, tuple(t.encode(text or "", add_special_tokens=False).ids + [2])] += 1
    by = {key: ids for key, ids in want}
    sequences, covered = {}, Counter()
    for r in got:
        ids = np.array(by[r.doc_id], "<u4")
        assert r.doc_tokens == len(ids) and r.length > 0
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        covered.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
    times = Counter(key for key, _ in texts)
    assert covered == {(key, k): times[key] for key, ids in want for k in range(len(ids))}
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding, sum(covered.values())


@pytest.mark.parametrize("fan", [16, 2])
def test_packing(spark, monkeypatch, fan):
    monkeypatch.setattr(packing, "FAN", fan)
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8))) for _ in range(300)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(int(rng.paretovariate(0.7) * 15) % 6000))) for i in range(250)]
    texts += [(1000, None), (1001, ""), (1002, " \n"), (1003, "don't É 42!\x00x\x1c\x85y　z Σας <|endoftext|> <|start"), (1004, "a" * 30_000), (None, "no id")]
    texts += [(1005, "the same row")] * 3
    frame = spark.createDataFrame([(i, t, "en", "a", 1, 2, 3, "x", 4) for i, t in texts], SCHEMA).repartition(9)
    got = packing.pack(frame, word_file()).collect()
    padding, n = unpacked(got, texts)
    assert padding <= n * 0.005
    assert sum(r.start > 0 for r in got) < len(texts)


def test_words_are_tokenised_as_whole_texts():
    import tokenizers

    words, whole = packing.Words(open(word_file()).read()), tokenizers.Tokenizer.from_file(word_file())
    rng = random.Random(12)
    bits = ["The", "END", "<|ENDOFTEXT|>", "<|endoftext|>", "<|EndOfText|>.", "don't", "Éa,", "e\u0301", "H\u0331", "h\u0331,", "ΣΑΣ", "İi", "x.", "y,", ",,", ".", "\x1c", "\u00a0", "漢字.", "🙂", "\u0915\u093c", "a" * 90, "1.5,", "\x00"]
    for _ in range(400):
        text = "".join(rng.choice(bits) + rng.choice([" ", " ", "\n", "", "\t "]) for _ in range(rng.randrange(12)))
        assert words.ids(text.encode()).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_packing_of_nothing(spark):
    assert packing.pack(documents(spark, []), word_file()).collect() == []
    assert [(r.doc_id, r.length) for r in packing.pack(documents(spark, [(1, None, None, None)]), word_file()).collect()] == [(1, 1)]


def test_packer_bounds():
    """No more than `most` windows are open; a closed one has at most `slack` free, but for the last."""
    rng, closed = random.Random(2), []
    packer = packing.Packer(lambda p: closed.append(sum(len(x.ids) for x in p)), length=64, most=4, slack=3)
    total = 0
    for k in range(500):
        n = rng.choice([1, 2, 5, 20, 40, 63, 64, 65, 200])
        packer.place([packing.Piece(k, 0, np.zeros(n, "<u4"), n)], n)
        total += n
        assert len(packer.open) <= 4
    assert all(61 <= n <= 64 for n in closed)
    whole = len(closed)
    packer.last()
    assert sum(closed) == total and all(n == 64 or n & (n - 1) == 0 for n in closed[whole:])

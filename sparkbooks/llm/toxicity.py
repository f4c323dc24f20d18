"""Toxicity by two class-conditional Kneser-Ney models of the characters of words.

One model is counted over texts labelled toxic, one over texts labelled ordinary. A word is spelt with a start and an end mark, and each
character is predicted from the ORDER - 1 before it. Contexts of SHARED characters and more have class counts. For strings of ORDER
characters and those at a word's begin these say in how many different texts of the class a word with that string stands; for
shorter ones, how many different characters stand before the string. Each count is discounted by less than one, so every string that
was seen stays, and backs off to shorter contexts (by a Pitman-Yor strength besides, which levels classes of different size). The shortest contexts have counts that both models share, gathered over all
documents, labelled or not: how many different words hold the string. So a rare expression that neither class knows says the same in
both, and an expression that is spelt like known ones is still told apart. A text's evidence is the mean over its words of the difference of the two
log-likelihoods; a logistic curve, fitted on labelled rows that the counts left out, turns it into a score.

The class counts come from a bounded sample of labelled rows (MOST_DOCS a class) and keep all of its strings. Of the shared counts,
those are looked up whose context ends a context of the sample; Spark picks them by a join, so the model that is broadcast grows with
the sample and not with the documents. Labels are the only thing learned from, and only outside the held-out fold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbooks.llm.shared import small_batches, written

#: Labelled rows of a class that are learned from at most: the first by the hash of their id.
MOST_DOCS = 6000
#: Of the labelled rows, one in so many fits the logistic curve and not the counts.
CALIBRATION = 4
ORDER, SHARED, DISCOUNT, SHARED_DISCOUNT = 6, 3, 0.75, 0.75
#: Counts that a context gives to shorter ones besides what the discounts leave them, in the smaller class; in the larger class as many more
#: as its sample is larger, so that what is rare in both is smoothed alike in both.
STRENGTH = 3.0
#: Characters of the longest word that is remembered whole (longer ones are spelt anew each time); the likelihood of a character that no count knows.
LONGEST, UNKNOWN = 40, 1 / 200
#: What a task holds at most: counted strings before it passes them on, words whose ratio it remembers, characters of texts whose words
#: are looked up together, and characters of words that are spelt at once. Together some tens of MB.
HELD, REMEMBERED, CHUNK, BATCH = 120_000, 200_000, 1_000_000, 300_000
#: Characters of counted words that a task holds before it passes them on: a run of word characters can be as long as a text.
HELD_CHARACTERS = 8_000_000
#: Texts that are turned into Python strings at once.
ROWS = 256

words_of = re.compile(r"\w+").findall


def in_fold(id_col: str, modulus: int = 5) -> Column:
    """Whether the row belongs to the held-out fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == 0, F.lit(False))


def strings(word: str, shortest: int, longest: int) -> Iterator[str]:
    """The strings of `shortest` to `longest` characters in the word between its marks, but for its start mark alone."""
    s = f"^{word}$"
    for end in range(2, len(s) + 1):
        for n in range(shortest, min(longest, end) + 1):
            yield s[end - n : end]


@dataclass
class Table:
    """Rows of numbers by the hash of a string: keys are sorted, so that many are looked up at once."""

    keys: np.ndarray
    rows: np.ndarray

    @staticmethod
    def of(strings: list[str], rows: np.ndarray) -> Table:
        keys = string_hashes(strings)
        at = np.argsort(keys, kind="stable")
        return Table(keys[at], rows[at])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes, and which of them are there."""
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return at, self.keys[at] == hashes


def extended(hashes: np.ndarray | int, codes: np.ndarray) -> np.ndarray:
    """The hashes of strings that are longer by one character on the left."""
    x = np.asarray(hashes, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + codes.astype(np.uint64) + np.uint64(1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def string_hashes(strings: list[str]) -> np.ndarray:
    """64-bit hashes of short strings."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    out = np.zeros(len(strings), np.uint64)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        codes = codes_of("".join(strings[i] for i in at)).reshape(len(at), n)
        hashes = np.zeros(len(at), np.uint64)
        for k in range(n - 1, -1, -1):
            hashes = extended(hashes, codes[:, k])
        out[at] = hashes
    return out


@dataclass
class Model:
    """kept: for a string the discounted share of its context in the ordinary and in the toxic class. weight: for a context the weight
    of shorter contexts there; 1 where it is absent. shared: the likelihood of the last character by the shared counts. Strings are held as
    64-bit hashes, in sorted arrays that take some 24 bytes a string."""

    kept: Table
    weight: Table
    shared: Table
    slope: float = 1.0
    shift: float = 0.0

    def ratios(self, words: list[str]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word, in batches of about BATCH characters."""
        out, begin = [], 0
        while begin < len(words):
            end, held = begin, 0
            while end < len(words) and (end == begin or held + len(words[end]) < BATCH):
                held += len(words[end]) + 2
                end += 1
            out.append(self._ratios(words[begin:end]))
            begin = end
        return np.concatenate(out) if out else np.zeros(0)

    def _ratios(self, words: list[str]) -> np.ndarray:
        codes = codes_of("".join(f"^{w}$" for w in words))
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(codes)) - np.repeat(starts, lengths)
        hashes = [np.zeros(len(codes), np.uint64)]
        for n in range(1, ORDER + 1):
            longer = np.zeros(len(codes), np.uint64)
            longer[n - 1 :] = extended(hashes[-1][n - 1 :], codes[: len(codes) - n + 1])
            hashes.append(longer)
        # a step depends on the last ORDER characters, or on those from the word's begin on: each such string is looked up once
        own = np.flatnonzero(place >= SHARED)
        strings = hashes[ORDER][own]
        for n in range(SHARED + 1, ORDER):
            strings[place[own] == n - 1] = hashes[n][own[place[own] == n - 1]]
        _, first, number = np.unique(strings, return_index=True, return_inverse=True)
        at = own[first]
        lower, unknown = np.full(len(at), UNKNOWN), np.arange(len(at))
        for n in range(SHARED, 0, -1):
            found, known = self.shared.find(hashes[n][at[unknown]])
            lower[unknown[known]] = self.shared.rows[found[known]]
            unknown = unknown[~known]
        both = np.stack([lower, lower])
        for n in range(SHARED + 1, ORDER + 1):
            long = np.flatnonzero(place[at] >= n - 1)
            context, known = self.weight.find(hashes[n - 1][at[long] - 1])
            long, context = long[known], context[known]
            string, known = self.kept.find(hashes[n][at[long]])
            share = np.where(known, self.kept.rows[string].T if len(self.kept.rows) else 0.0, 0.0)
            both[:, long] = share + self.weight.rows[context].T * both[:, long]
        steps = np.zeros(len(codes))
        steps[own] = np.log(both[1] / both[0])[number]
        return np.add.reduceat(steps, starts)

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * evidence + self.shift))))


class Ratios:
    """Evidence of texts by a model; what words came to is remembered up to REMEMBERED words, but for long ones."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}

    def evidence(self, texts: list[str | None]) -> list[float]:
        """The mean ratio of each text's words; 0 without words."""
        out, begin = [], 0
        while begin < len(texts):
            listed, held = [], 0
            while begin + len(listed) < len(texts) and (not listed or held < CHUNK):
                text = texts[begin + len(listed)] or ""
                held += len(text)
                listed.append(words_of(text.lower()))
            begin += len(listed)
            if len(self.known) > REMEMBERED:
                self.known.clear()
            new = list({w for words in listed for w in words if w not in self.known})
            fresh = dict(zip(new, self.model.ratios(new).tolist(), strict=True))
            long = {w: fresh.pop(w) for w in new if len(w) > LONGEST}
            self.known.update(fresh)
            for words in listed:
                ratios = [self.known[w] if len(w) <= LONGEST else long[w] for w in words] if long else map(self.known.__getitem__, words)
                out.append(math.fsum(ratios) / len(words) if words else 0.0)
        return out


def shared_likelihoods(counts: dict[str, int]) -> dict[str, float]:
    """Interpolated Kneser-Ney over strings of 1 to SHARED characters."""
    total: Counter[str] = Counter()
    kinds: Counter[str] = Counter()
    for string, n in counts.items():
        total[string[:-1]] += n
        kinds[string[:-1]] += 1
    out: dict[str, float] = {}
    for string in sorted(counts, key=len):
        context = string[:-1]
        lower = out.get(string[1:], UNKNOWN) if context else UNKNOWN
        d = SHARED_DISCOUNT
        out[string] = (max(counts[string] - d, 0) + d * kinds[context] * lower) / total[context]
    return out


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve through evidence x and labels y: Newton steps with a small ridge."""
    if len(set(y.tolist())) < 2:
        return 1.0, (-1.0 if not len(y) or y[0] == 0 else 1.0)
    middle, scale = x.mean(), x.std() or 1.0
    z = (x - middle) / scale
    weight = 1 / len(y)
    a = b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        g = np.array([(weight * (p - y) * z).sum() + 1e-3 * a, (weight * (p - y)).sum()])
        v = weight * p * (1 - p) + 1e-9
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-9]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return a / scale, b - a * middle / scale


def _per_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, word, n): in how many of the class's texts a word stands."""
    counts: Counter[tuple[int, str]] = Counter()
    held = 0

    def out() -> pa.RecordBatch:
        kinds, words = list(zip(*counts, strict=True)) or [[], []]
        arrays = [pa.array(kinds, pa.int32()), pa.array(words, pa.string()), pa.array(counts.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["kind", "word", "n"])

    for kind, text in _rows(batches):
        words = set(words_of((text or "").lower()))
        counts.update((kind, w) for w in words)
        held += sum(len(w) for w in words if len(w) > LONGEST)
        if len(counts) > HELD or held > HELD_CHARACTERS:
            yield out()
            counts.clear()
            held = 0
    yield out()


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: set[str] = set()
    held = 0
    for (text,) in _rows(batches):
        if text:
            new = set(words_of(text.lower())) - words
            words |= new
            held += sum(len(w) for w in new if len(w) > LONGEST)
        if len(words) > HELD or held > HELD_CHARACTERS:
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], ["word"])
            words.clear()
            held = 0
    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], ["word"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield from zip(*(c.to_pylist() for c in batch.slice(k, ROWS).columns), strict=True)


def _per_string(shortest: int, longest: int, weighed: bool):
    """(class, string, n): from words to their strings; a word counts as n or as 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, str], int] = {}

        def out() -> pa.RecordBatch:
            kinds, names = list(zip(*counts, strict=True)) or [[], []]
            arrays = [pa.array(kinds, pa.int32()), pa.array(names, pa.string()), pa.array(counts.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["kind", "string", "n"])

        for batch in batches:
            for kind, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for string in strings(word, shortest, longest):
                    counts[kind, string] = counts.get((kind, string), 0) + (n if weighed else 1)
                    if len(counts) > HELD:
                        yield out()
                        counts.clear()
        yield out()

    return run


def word_counts(texts: DataFrame) -> DataFrame:
    """(kind, word, n) of a table (kind, text): the number of texts of the kind that hold the word."""
    parts = texts.mapInArrow(_per_word, "kind int, word string, n long")
    return parts.groupBy("kind", "word").agg(F.sum("n").alias("n"))


def string_counts(words: DataFrame, shortest: int, longest: int, weighed: bool) -> DataFrame:
    parts = words.select("kind", "word", "n").mapInArrow(_per_string(shortest, longest, weighed), "kind int, string string, n long")
    return parts.groupBy("kind", "string").agg(F.sum("n").alias("n"))


def continuations(counts: DataFrame) -> DataFrame:
    """(kind, string, n) of raw counts: as they are for strings of ORDER characters and at a word's begin; else n is the number of
    different characters before the string. Each of those makes a string one longer, which must be among the counts."""
    top = (F.length("string") == ORDER) | F.col("string").startswith("^")
    whole = F.when(top, F.struct("string", "n"))
    ending = F.when(F.length("string") > SHARED + 1, F.struct(F.expr("substring(string, 2)").alias("string"), F.lit(1).cast("long").alias("n")))
    both = counts.select("kind", F.explode(F.array_compact(F.array(whole, ending))).alias("part")).select("kind", "part.string", "part.n")
    return both.groupBy("kind", "string").agg(F.sum("n").alias("n"))


def class_tables(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (kind, word, n) the tables (string, ordinary, toxic) of discounted shares, and (context, ordinary, toxic) of what is left for
    shorter contexts. For each context of a class the shares and what is left add up to 1."""
    sizes = {r[0]: r[1] for r in words.groupBy("kind").agg(F.sum("n")).collect()}
    least = min([sizes.get(0, 0), sizes.get(1, 0)]) or 1
    strength = {c: STRENGTH * max(1.0, sizes.get(c, 0) / least) for c in (0, 1)}
    counts = written(continuations(string_counts(words, SHARED + 1, ORDER, weighed=True)), "toxic-strings")
    context = F.expr("left(string, length(string) - 1)")
    totals = counts.groupBy("kind", context.alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("different"))
    totals = totals.withColumn("strength", F.when(F.col("kind") == 0, strength[0]).otherwise(strength[1]))
    totals = written(totals.withColumn("whole", F.col("total") + F.col("strength")), "toxic-contexts")
    left = (F.col("strength") + DISCOUNT * F.col("different")) / F.col("whole")
    shares = counts.withColumn("context", context).join(totals, ["kind", "context"])
    share = (F.col("n") - DISCOUNT) / F.col("whole")
    return _by_class(shares, "string", share, 0.0), _by_class(totals, "context", left, 1.0)


def _by_class(rows: DataFrame, key: str, value: Column, absent: float) -> DataFrame:
    one = [F.coalesce(F.max(F.when(F.col("kind") == c, value)), F.lit(absent)).alias(name) for c, name in enumerate(("ordinary", "toxic"))]
    return rows.groupBy(key).agg(*one)


def shared_counts(docs: DataFrame, contexts: DataFrame, text_col: str = "text") -> DataFrame:
    """(string, n): in how many different words of all documents each string of 1 to SHARED characters stands whose context ends one of `contexts`."""
    words = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_distinct_words, "word string").distinct()
    kind = F.lit(0).alias("kind")
    short = string_counts(words.select(kind, "word", F.lit(1).cast("long").alias("n")), 1, SHARED, weighed=False)
    short = short.select("string", "n", F.expr("left(string, length(string) - 1)").alias("context"))
    ends = contexts.select(F.explode(F.array(*[F.right("context", F.lit(n)) for n in range(SHARED)])).alias("context")).distinct()
    return short.join(ends, "context", "left_semi").select("string", "n")


def _table(rows: DataFrame) -> Table:
    arrow = rows.toArrow()
    return Table.of(arrow.column(0).to_pylist(), np.stack([c.to_numpy() for c in arrow.columns[1:]], axis=1) if arrow.num_rows else np.zeros((0, 2)))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_docs: int = MOST_DOCS
) -> Model:
    """A model from the rows of docs that labels marks 0 or 1 and that are not in the held-out fold.

    Null ids and labels are not learned from; of rows that label an id more than once the larger label holds; equal texts of
    a class count once. Without a labelled row of one class the score is below one half (no toxic rows) or above (no ordinary rows).
    """
    small_batches(docs.sparkSession)
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    marks = marks.where("id IS NOT NULL AND toxic IN (0, 1)").where(~in_fold("id"))
    marks = marks.groupBy("id").agg(F.max("toxic").alias("toxic")).withColumn("place", F.md5(F.col("id").cast("string").cast("binary")))
    first = [marks.where(F.col("toxic") == c).orderBy("place").limit(most_docs) for c in (0, 1)]
    part = F.conv(F.substring("place", 1, 8), 16, 10).cast("long") % CALIBRATION
    sample = first[0].unionByName(first[1]).select("id", "toxic", (part == 0).alias("held"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    chosen = written(texts.join(F.broadcast(sample), "id").select("toxic", "held", "text"), "toxic-sample")

    learned = chosen.where("NOT held").select(F.col("toxic").alias("kind"), "text").distinct()
    shares, left = class_tables(written(word_counts(learned), "toxic-words"))
    left = written(left, "toxic-left")
    shared = shared_likelihoods({r.string: r.n for r in shared_counts(docs, left, text_col).toLocalIterator()})
    model = Model(_table(shares), _table(left), Table.of(list(shared), np.fromiter(shared.values(), float, len(shared))))
    evidence = chosen.where("held").select("toxic", evidence_of(model)("text").alias("evidence")).toPandas()
    model.slope, model.shift = logistic(evidence["evidence"].to_numpy(), evidence["toxic"].to_numpy())
    return model


def evidence_of(model: Model, curve: bool = False):
    """A column function from texts to their evidence or, with `curve`, their scores. Only the texts go to Python, and only numbers come back."""
    small_batches(SparkSession.active())
    shared = SparkSession.active().sparkContext.broadcast(model)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        ratios = Ratios(model)
        for column in columns:
            out = []
            for k in range(0, len(column), ROWS):
                out += ratios.evidence(column.slice(k, ROWS).to_pylist())
            yield pa.array(map(model.score, out) if curve else out, pa.float64())

    return F.arrow_udf(run, "double")


def apply(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): one row for each row of docs; the score is from 0 to 1, higher where toxic is likelier.

    A null text is scored as an empty one, which gets the curve's value at no evidence. Texts are scored whole, whatever
    their length. Repeated rows are scored each; no rows give no rows; no other column is looked at.
    """
    return docs.select(id_col, evidence_of(model, curve=True)(F.col(text_col).cast("string")).alias("score"))


def keep_ordinary(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the model scores below one half.

    A null text is scored as an empty one. Repeated rows stay or go together; no rows give no rows. Other columns are not looked at,
    whatever their names.
    """
    return docs.where(evidence_of(model, curve=True)(docs[text_col].cast("string")) < 0.5)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted): fit() and then apply() to all rows of docs, a row for each.

    Null and empty texts have the score of no evidence. Rows that repeat are scored each, alike; a null id is not held out. Without labels of one class
    the score is as fit() says. No rows give no rows; other columns are not looked at."""
    scored = apply(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
    return scored.select(id_col, in_fold(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accuracy(labels: list[int], scores: list[float]) -> dict[str, float]:
    """Area under the curve, and recall and precision at one half."""
    y, s = np.array(labels), np.array(scores)
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    hit = y == 1
    auc = (rank[hit].sum() - hit.sum() * (hit.sum() + 1) / 2) / max(1, hit.sum() * (~hit).sum())
    called = s >= 0.5
    return {
        "auc": float(auc),
        "recall": float((called & hit).sum() / max(1, hit.sum())),
        "precision": float((called & hit).sum() / max(1, called.sum())),
        "false_alarms": float((called & ~hit).sum() / max(1, (~hit).sum())),
    }

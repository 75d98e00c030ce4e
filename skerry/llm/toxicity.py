"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary texts, give each word a probability: the number of different words it follows, as in
Kneser-Ney's lower orders (so that copies of a text count once), less a discount, and the mass so freed
times a backoff that both classes share, by the number of classes a word type continues in. What the backoff keeps for unseen words
goes by a Kneser-Ney model of the letters of each class's word types, whose lowest orders again count both classes together. The order
above has the word before as context: a pair counts the different words it follows, less a discount; what that frees goes by a backoff that
both classes share, the number of classes a pair is found in, less a discount again, and at last by the word's own probability. A text's score compares the length-normalised log-likelihoods of both orders under both classes, of the whole text and of its most
suspicious stretch, calibrated by a logistic regression on labelled texts that the models haven't seen.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import process_cache, ship

WORD = re.compile(r"[^\W_]+")
ORDER, SHARED_ORDER = 4, 2
DISCOUNT = 0.75
WORD_DISCOUNTS = (0.75, 1.3, 1.6)  # of words seen once, twice, and more often
PAIR_DISCOUNT = 0.75
FEATURES = 6
UNSEEN = 0.1
SPAN = 3
SAMPLE = 3000
LIMIT, UNSEEN_LIMIT = 8.0, 1.5  # of a word's log ratio; the letters of an unseen word are weaker evidence
MEMO = 300_000
PART_CHARS = 2_000_000
PRIME = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def word_code(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


@dataclass
class Counts:
    """Counts by code, looked up by binary search; codes that aren't there count nothing."""

    codes: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray, weights: np.ndarray | None = None) -> Counts:
        codes, inverse = np.unique(codes, return_inverse=True)
        return cls(codes, np.bincount(inverse, weights, minlength=len(codes)).astype(np.float64))

    def at(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(len(codes))
        i = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[i] == codes, self.values[i], 0.0)


def letters(types: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each between a start (2) and an end (3), and each one's place in its word."""
    text = "".join(f"\x02{w}\x03" for w in types)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in types])
    place = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return chars, place


def gram_codes(chars: np.ndarray, order: int) -> np.ndarray:
    """A code of the so many letters that end at each place (nonsense where a word has fewer)."""
    code = np.full(len(chars), order, np.uint64)
    for back in range(order - 1, -1, -1):
        shifted = np.concatenate([np.zeros(back, np.uint64), chars])[: len(chars)]
        code = (code * np.uint64(31) + shifted) * PRIME
        code ^= code >> np.uint64(29)
    return code


def pair_codes(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    code = (before * np.uint64(31) + word) * PRIME
    return code ^ (code >> np.uint64(29))


@dataclass
class PairModel:
    """Counts of word pairs and of their first words, of ordinary (0) and toxic (1) texts side by side, looked up by code."""

    codes: np.ndarray
    values: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray

    @classmethod
    def of(cls, toxic: np.ndarray, before: np.ndarray, word: np.ndarray, n: np.ndarray) -> PairModel:
        codes, at = np.unique(pair_codes(before, word), return_inverse=True)
        contexts, of = np.unique(before, return_inverse=True)
        values, totals, kinds = (np.zeros((len(x), k), np.float32) for x, k in ((codes, 2), (contexts, 2), (contexts, 3)))
        np.add.at(values, (at, toxic), n)
        np.add.at(totals, (of, toxic), n)
        np.add.at(kinds, (of, toxic), 1)
        np.add.at(kinds[:, 2], of[np.unique(at, return_index=True)[1]], 1)  # of either class
        return cls(codes, values, contexts, totals, kinds)

    @staticmethod
    def _rows(keys: np.ndarray, codes: np.ndarray, *tables: np.ndarray) -> list[np.ndarray]:
        i = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        found = (keys[i] == codes)[:, None]
        return [np.where(found, t[i], np.float32(0)) for t in tables]

    def context(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each first word: the total of its pairs by class, and how many there are by class and in all."""
        total, kinds = self._rows(self.contexts, codes, self.totals, self.kinds)
        return total, kinds

    def ratio(self, before: np.ndarray, word: np.ndarray, total: np.ndarray, kinds: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """Log ratios (toxic to ordinary) of words after others, from context() of those before and the words' log probabilities by themselves."""
        (c,) = self._rows(self.codes, pair_codes(before, word), self.values)
        p = np.exp(alone)
        classes, of_classes = (c > 0).sum(axis=1, keepdims=True), kinds[:, :2].sum(axis=1, keepdims=True)
        p = np.where(of_classes > 0, (np.maximum(classes - PAIR_DISCOUNT, 0) + PAIR_DISCOUNT * kinds[:, 2:] * p) / np.maximum(of_classes, 1), p)
        p = np.where(total > 0, (np.maximum(c - PAIR_DISCOUNT, 0) + PAIR_DISCOUNT * kinds[:, :2] * p) / np.maximum(total, 1), p)
        logs = np.log(p)
        return logs[:, 1] - logs[:, 0]


@dataclass
class LetterModel:
    """Interpolated Kneser-Ney over the letters of word types."""

    grams: list[Counts] = field(default_factory=list)
    totals: list[Counts] = field(default_factory=list)
    kinds: list[Counts] = field(default_factory=list)

    @classmethod
    def fit(cls, types: list[str], shared: list[str]) -> LetterModel:
        model = cls()
        for order in range(1, ORDER + 1):
            chars, place = letters(shared if order <= SHARED_ORDER else types)
            full = place >= max(order - 1, 1)
            codes = gram_codes(chars, order)[full]
            before = np.concatenate([np.zeros(1, np.uint64), gram_codes(chars, order - 1)[:-1]])[full] if order > 1 else np.zeros(len(codes), np.uint64)
            model.grams.append(Counts.of(codes))
            model.totals.append(Counts.of(before))
            model.kinds.append(Counts.of(before[np.unique(codes, return_index=True)[1]]))  # a code has one beginning
        return model

    def log_probability(self, types: list[str]) -> np.ndarray:
        chars, place = letters(types)
        p = np.full(len(chars), 1 / 500.0)
        for order in range(1, ORDER + 1):
            full = place >= max(order - 1, 1)
            codes = gram_codes(chars, order)[full]
            before = np.concatenate([np.zeros(1, np.uint64), gram_codes(chars, order - 1)[:-1]])[full] if order > 1 else np.zeros(len(codes), np.uint64)
            n, t, g = self.totals[order - 1].at(before), self.kinds[order - 1].at(before), self.grams[order - 1].at(codes)
            n1 = np.maximum(n, 1)
            p[full] = np.where(n > 0, (np.maximum(g - DISCOUNT, 0) + DISCOUNT * t * p[full]) / n1, p[full])
        logs = np.where(place > 0, np.log(p), 0.0)
        starts = np.flatnonzero(place == 0)
        return np.add.reduceat(logs, starts)


@dataclass
class WordModel:
    counts: Counts
    shared: Counts
    letters: LetterModel

    @classmethod
    def fit(cls, words_: list[str], counts: np.ndarray, shared: list[str], shared_counts: Counts) -> WordModel:
        codes = np.array([word_code(w) for w in words_], np.uint64)
        return cls(Counts.of(codes, counts), shared_counts, LetterModel.fit(words_, shared))

    def log_probability(self, types: list[str], codes: np.ndarray) -> np.ndarray:
        c, n = self.counts.at(codes), max(self.counts.values.sum(), 1.0)
        steps = np.array([0.0, *WORD_DISCOUNTS])
        freed = steps[np.minimum(self.counts.values, 3).astype(int)].sum() / n
        backoff = (1 - UNSEEN) * self.shared.at(codes) / max(self.shared.values.sum(), 1.0)
        new = np.flatnonzero(backoff == 0)
        if len(new):
            backoff[new] = UNSEEN * np.exp(np.maximum(self.letters.log_probability([types[i] for i in new]), -600))  # very long words have no chance under either
        kept = np.maximum(c - steps[np.minimum(c, 3).astype(int)], 0) / n
        return np.log(kept + freed * backoff)


class Memo:
    """What a model says of the words that this process has met: each word's place in the arrays."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.codes = np.zeros(0, np.uint64)
        self.logs, self.totals, self.kinds = np.zeros((0, 2)), np.zeros((0, 2), np.float32), np.zeros((0, 3), np.float32)
        self.ratios = np.zeros(0)


@dataclass
class ToxicityModel:
    toxic: WordModel
    ordinary: WordModel
    pairs: PairModel | None = None
    weights: np.ndarray | None = None

    @property
    def memo(self) -> Memo:
        """The memo of this process, for one model at a time."""
        held = process_cache("toxicity")
        if held.get("model") is not self:
            held.update(model=self, memo=Memo())
        return held["memo"]

    def learn(self, types: set[str]) -> Memo:
        memo = self.memo
        types = types | {""}  # the start of a text is the context of its first word
        new = [w for w in types if w not in memo.at]
        if len(memo.at) + len(new) > MEMO:
            memo.__init__()
            new = list(types)
        parts: list[tuple] = [(memo.codes, memo.logs, memo.totals, memo.kinds, memo.ratios)]
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            codes = np.array([word_code(w) for w in part], np.uint64)
            logs = np.stack([m.log_probability(part, codes) for m in (self.ordinary, self.toxic)], axis=1)
            most = np.where(self.toxic.shared.at(codes) > 0, LIMIT, UNSEEN_LIMIT)
            parts.append((codes, logs, *self.pairs.context(codes), np.clip(logs[:, 1] - logs[:, 0], -most, most)))
        if new:
            memo.at.update(zip(new, range(len(memo.at), len(memo.at) + len(new))))
            memo.codes, memo.logs, memo.totals, memo.kinds, memo.ratios = (np.concatenate(x) for x in zip(*parts))
        return memo

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: constant; mean log ratio, the best stretch's and the best word's of words alone; mean and best stretch's of words after others."""
        split = [words(t) for t in texts]
        out = np.zeros((len(texts), FEATURES))
        out[:, 0] = 1
        memo = self.learn({w for ws in split for w in ws})
        sizes = np.array([len(ws) for ws in split], np.int64)
        at = np.fromiter((memo.at[w] for ws in split for w in ws), np.int64, sizes.sum())
        ends = np.cumsum(sizes)
        before = np.concatenate([[memo.at[""]], at[:-1]]) if len(at) else at
        before[(ends - sizes)[sizes > 0]] = memo.at[""]
        alone = memo.ratios[at]
        after = np.zeros(len(at))
        for i in range(0, len(at), 200_000):
            a, b = at[i : i + 200_000], before[i : i + 200_000]
            after[i : i + 200_000] = self.pairs.ratio(memo.codes[b], memo.codes[a], memo.totals[b], memo.kinds[b], memo.logs[a])
        # an unseen word stays the weak evidence that it is by itself
        limits = np.where(self.toxic.shared.at(memo.codes) > 0, LIMIT, UNSEEN_LIMIT)[at]
        after = np.clip(after, -limits, limits)
        for i, (size, end) in enumerate(zip(sizes.tolist(), ends.tolist())):
            if size:
                k = min(SPAN, size)
                for j, r in ((1, alone[end - size : end]), (4, after[end - size : end])):
                    s = np.cumsum(np.concatenate([[0.0], r]))
                    out[i, j : j + 2] = r.mean(), (s[k:] - s[:-k]).max() / k
                out[i, 3] = alone[end - size : end].max()
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-self.features(texts) @ self.weights))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (weight * (y - p)) - ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def in_fold(doc_id: str = "doc_id", folds: int = 5):
    """crc32 of the id as text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """At most about so many texts of each class, chosen by a hash of the id, outside of fold 0: text, toxic, part, weight (labels of the class for each chosen one)."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(in_fold() != 0)
    per_class = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    share, weight = F.lit(0.0), F.lit(1.0)
    for c, n in per_class.items():
        share = F.when(F.col("toxic") == c, F.lit(1e6 * sample / n)).otherwise(share)
        weight = F.when(F.col("toxic") == c, F.lit(max(1.0, n / sample))).otherwise(weight)
    chosen = known.where(place < share).withColumn("part", (F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(3)) == 0).cast("int")).withColumn("weight", weight)
    # the sample is bounded by its parameter, and so is this broadcast
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic", "part", "weight")


def _word_triples(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, code of the word two before, code of the word before, word), different ones of some texts at a time."""
    found: set[tuple[int, int, int, str]] = set()
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string())

    def out() -> pa.RecordBatch:
        columns = [pa.array([x[i] for x in found], t) for i, t in enumerate(kinds)]
        found.clear()
        return pa.RecordBatch.from_arrays(columns, names=["toxic", "left", "before", "word"])

    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            ws = words(text.as_py())
            coded = {w: word_code(w) - (1 << 63) for w in {"", *ws}}
            start = coded[""]
            left, before = start, start
            for w in ws:
                found.add((toxic, left, before, w))
                left, before = before, coded[w]
                if len(found) > 200_000:
                    yield out()
    if found:
        yield out()


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Learn from at most about sample labelled texts of each class (a documented bound: the model is of a fixed size).

    Two thirds of them give the counts, the rest calibrates, each class by the weight of all its labels. Without labels of both classes the model scores everything 0.
    """
    ship(docs.sparkSession)
    rows = labelled_sample(docs, labels, sample)
    triples = rows.where("part = 0").select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_word_triples, "toxic int, left long, before long, word string").distinct()
    # the pairs of the sample, each with the number of different words before it
    table = triples.groupBy("toxic", "before", "word").agg(F.count(F.lit(1)).cast("int").alias("n")).toArrow().combine_chunks()
    toxic, n = table["toxic"].to_numpy(), table["n"].to_numpy()
    before = table["before"].to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
    coded = pc.dictionary_encode(table["word"]).combine_chunks()
    del table
    types, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    by = {c: np.bincount(at[toxic == c], minlength=len(types)) for c in (0, 1)}  # the number of different words before a word
    if not all(by[c].any() for c in by):
        none = Counts(np.zeros(0, np.uint64), np.zeros(0))
        empty = WordModel(none, none, LetterModel())
        return ToxicityModel(empty, empty)
    codes = np.array([word_code(w) for w in types], np.uint64)
    pairs = PairModel.of(toxic, before, codes[at], n)
    classes = Counts.of(codes, sum((by[c] > 0).astype(float) for c in by))
    models = []
    for c in by:
        seen = np.flatnonzero(by[c])
        models.append(WordModel.fit([types[i] for i in seen], by[c][seen].astype(float), types, classes))
    del types, at, by, classes, coded, codes, toxic, n, before
    gc.collect()
    pa.default_memory_pool().release_unused()
    model = ToxicityModel(models[1], models[0], pairs)
    # where a table is so small that nothing is left to calibrate with, the counted texts serve
    names = [f"f{i}" for i in range(FEATURES)]
    schema = "toxic int, weight double, " + ", ".join(f"{x} double" for x in names)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                batch = whole.slice(at, 100)
                f = sent.value.features(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("weight"), *[pa.array(f[:, i]) for i in range(FEATURES)]], names=["toxic", "weight", *names])

    held = rows.where("part = 1").select("text", F.col("toxic").cast("int").alias("toxic"), "weight").mapInArrow(measure, schema).toPandas()
    if held["toxic"].nunique() < 2:
        held = rows.select("text", F.col("toxic").cast("int").alias("toxic"), "weight").mapInArrow(measure, schema).toPandas()
    held = held.sort_values(held.columns.tolist())
    sent.destroy()
    model.weights = fit_logistic(held[names].to_numpy(), held["toxic"].to_numpy(float), held["weight"].to_numpy())
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """All columns of docs with score (0 to 1, higher: likelier toxic) and predicted (1 from 0.5).

    A text's score depends on its words alone: null and empty texts get the calibrated score of no words; repeated rows get equal scores; columns called score
    or predicted are replaced. An empty table gives an empty one.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        out, part, held = [], [], 0
        for t in texts:
            part.append(t or "")
            held += len(part[-1])
            if held > PART_CHARS:
                out.append(sent.value.score(part))
                part, held = [], 0
        out.append(sent.value.score(part))
        return pd.Series(np.concatenate(out))

    return docs.withColumn("score", score(F.col("text"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fit on the labels (doc_id, toxic) of docs (doc_id, text) and score all docs; see fit_toxicity and score_toxicity."""
    return score_toxicity(docs, fit_toxicity(docs, labels, sample))

"""Toxicity by cumulative-link ordinal regression (operator 8).

Severity grades are ordered. One weight vector over sparse text features (words,
their prefixes, and the density of words that speak for toxicity) is shared by all
thresholds: ``P(grade > k) = sigmoid(w.x - t_k)`` with ``t_0 < t_1 < ...``. The
output is the expected severity, the sum of these probabilities.

Labels may be grades of any number. Where they are only 0 and 1, the tables know
no more than that: a toxic document then has grade 1 or 2, parted at the median
density of toxic words among the toxic ones, which is itself a feature. The
severity then restates, beside the chance of being toxic, how dense such words
are; no one has graded it.

Features are those whose association with the toxic class (grade above 0) is beyond
what about one of all candidates (in ``LEAST_DOCS`` toxic documents; in fewer, none
could be) would reach by chance, by a likelihood ratio, and ``least_share`` of
whose documents are toxic; however many they are, their weights
do the rest. The share is a choice: without it, words that only go along with
toxic texts (those of their subjects, or of their many copies) enter, and held-out
errors of both kinds rise (see the README). Fitting reads a bounded sample of
labelled rows (``train_docs``, as many of either class where it has them, chosen by
a hash of the id), equal texts once, weighted so that classes count as they stand
in the labels. Scoring reads every word of every text. Word forms are remembered
per worker.

Defined cases: a null text counts as empty, and an empty text scores as one
without features; labels that are null, negative or of unknown documents are
ignored, and of several the largest holds; without labels of both classes nothing
is toxic (all scores 0); repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim_memory, cut, join_counted, letter_runs, slices

#: Prefix lengths that are features beside the whole word.
PREFIXES = (4, 5, 6)
#: Toxic documents of the sample that a feature must be in to be tested.
LEAST_DOCS = 3
#: Word forms that one Python worker remembers, and how long they may be.
CACHE_WORDS, LONG_FORM = 250_000, 64


def word_features(form: str) -> list[str]:
    """Features of a part between white space: its letter runs and their prefixes."""
    out = []
    for word in letter_runs(form.lower()):
        out.append(word)
        out += [f"{word[:k]}*" for k in PREFIXES if len(word) >= k]
    return out


def likelihood_ratio(toxic: Column, clean: Column, toxic_docs: int, clean_docs: int) -> Column:
    """Of a feature's presence in so many documents of either class."""
    docs, present = float(toxic_docs + clean_docs), (toxic + clean).cast("double")
    cells = (
        (toxic, toxic_docs * present), (clean, clean_docs * present),
        (toxic_docs - toxic, toxic_docs * (docs - present)), (clean_docs - clean, clean_docs * (docs - present)),
    )
    return 2 * sum((F.when(seen > 0, seen * F.ln(seen * docs / expected)).otherwise(0.0) for seen, expected in cells), F.lit(0.0))


@dataclass
class Ordinal:
    """Shared weights and ordered thresholds; the last weight is that of the density."""

    index: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray
    forms: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"forms": {}}

    def ids_of(self, form: str) -> tuple[int, ...]:
        found = tuple(self.index[f] for f in word_features(form) if f in self.index)
        if len(self.forms) < CACHE_WORDS and len(form) <= LONG_FORM:
            self.forms[form] = found
        return found

    def counts(self, text: str) -> tuple[Counter, int, int]:
        """Feature counts, parts with features, and parts."""
        parts = text.split()
        known = self.forms
        hits = [h for p in parts if (h := known[p] if p in known else self.ids_of(p))]
        return Counter(i for h in hits for i in h), len(hits), len(parts)

    def vector(self, counts: Counter, hits: int, parts: int) -> tuple[list[int], list[float]]:
        ids = sorted(counts)
        return [*ids, len(self.index)], [*(1 + math.log(counts[i]) for i in ids), density(hits, parts)]

    def exceed(self, text: str) -> np.ndarray:
        """P(grade > k) for each k."""
        ids, values = self.vector(*self.counts(text))
        score = float(self.weights[ids] @ np.array(values))
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -500, 500)))


def density(hits: int, parts: int) -> float:
    return math.log1p(100 * hits / parts) if parts else 0.0


def fit(
    ids: np.ndarray, values: np.ndarray, lengths: np.ndarray, grades: np.ndarray, many: np.ndarray, features: int, *, steps: int = 1500, rate: float = 0.05, ridge: float = 1e-5, still: float = 1e-7
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the ordinal likelihood, until a step gains less than ``still``.

    Row ``k`` has the next ``lengths[k]`` of ``ids`` and ``values``, grade ``grades[k]``, and counts ``many[k]`` times.
    """
    rows = len(grades)
    owner = np.repeat(np.arange(rows), lengths)
    levels = max(1, int(grades.max()))
    # Thresholds are a first one and positive steps, so they stay in order.
    theta = np.concatenate([np.zeros(features), [1.0], np.zeros(levels - 1)])
    m, v, before = np.zeros_like(theta), np.zeros_like(theta), math.inf
    for step in range(1, steps + 1):
        weights, first, gaps = theta[:features], theta[features], np.exp(theta[features + 1 :])
        cuts = first + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(owner, weights[ids] * values, minlength=rows)
        exceed = 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -500, 500)))
        # P(grade = k) = exceed[k-1] - exceed[k]; its log-likelihood gradient by threshold.
        padded = np.concatenate([np.ones((rows, 1)), exceed, np.zeros((rows, 1))], axis=1)
        at = np.arange(rows)
        chance = np.maximum(padded[at, grades] - padded[at, grades + 1], 1e-12)
        loss = -(many * np.log(chance)).sum() / many.sum() + ridge * (weights**2).sum() / 2
        if step % 20 == 0:
            if before - loss < 20 * still:
                break
            before = loss
        slope = padded * (1 - padded)
        by_score = many * (slope[at, grades] - slope[at, grades + 1]) / chance
        by_cut = np.zeros((rows, levels))
        lower, upper = grades > 0, grades < levels
        by_cut[at[lower], grades[lower] - 1] -= many[lower] * slope[at[lower], grades[lower]] / chance[lower]
        by_cut[at[upper], grades[upper]] += many[upper] * slope[at[upper], grades[upper] + 1] / chance[upper]
        by_cut = by_cut.sum(axis=0)
        grad = np.empty_like(theta)
        grad[:features] = np.bincount(ids, by_score[owner] * values, minlength=features) - ridge * many.sum() * weights
        grad[features] = by_cut.sum()
        for k in range(1, levels):
            grad[features + k] = by_cut[k:].sum() * gaps[k - 1]
        grad /= many.sum()
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:features], theta[features] + np.concatenate([[0.0], np.cumsum(np.exp(theta[features + 1 :]))])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = 20_000, least_share: float = 0.9) -> Ordinal | None:
    """Fit on at most about ``train_docs`` labelled rows; None without both classes."""
    spark = docs.sparkSession
    known = labels.where((F.col(label_col) >= 0) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("grade"))
    known = known.withColumn("toxic", (F.col("grade") > 0).cast("int"))
    many = dict(known.groupBy("toxic").count().collect())
    if len(many) < 2:
        return None
    # What one class leaves of its half, the other may use.
    half = train_docs // 2
    asked = {t: max(half, train_docs - min(half, many[1 - t])) for t in (0, 1)}
    bars = F.when(F.col("toxic") == 1, F.lit(_share(asked[1], many[1]))).otherwise(F.lit(_share(asked[0], many[0])))
    kept = known.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < bars)
    found = join_counted(docs.select(id_col, F.col(text_col).alias("text")), kept, id_col, "inner")
    sample = cut(found.groupBy(F.md5(F.coalesce("text", F.lit("")))).agg(F.first("text").alias("text"), F.max("grade").alias("grade")).select("text", "grade"))
    per_class = {bool(toxic): n for toxic, n in sample.groupBy(F.col("grade") > 0).count().collect()}
    if len(per_class) < 2:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for batch in slices(batches):
            for text, grade in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[grade > 0].update({f for p in set((text or "").split()) for f in word_features(p)})
        names = sorted(set(seen[0]) | set(seen[1]))
        for i in range(0, len(names), 10_000):
            part = names[i : i + 10_000]
            yield pa.record_batch(
                [pa.array(part), pa.array([seen[1][n] for n in part], pa.int64()), pa.array([seen[0][n] for n in part], pa.int64())], names=["feature", "toxic", "clean"]
            )

    counted = cut(sample.mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") >= LEAST_DOCS))
    least = 2 * math.log(max(counted.count(), 1)) + 2
    ratio = likelihood_ratio(F.col("toxic"), F.col("clean"), per_class[True], per_class[False])
    # Features against toxicity have small shares.
    telling = counted.where((ratio >= least) & (F.col("toxic") >= least_share * (F.col("toxic") + F.col("clean"))) & (F.col("toxic") * per_class[False] > F.col("clean") * per_class[True]))
    index = {f: i for i, f in enumerate(sorted(r.feature for r in telling.select("feature").collect()))}
    empty = Ordinal(index, np.zeros(len(index) + 1), np.array([0.0]))
    shared = spark.sparkContext.broadcast(empty)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_memory("toxicity features", shared.value.forms.clear)
        for batch in slices(batches):
            got = [shared.value.vector(*shared.value.counts(t or "")) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float64())), batch.column(1)], names=["ids", "values", "grade"])

    # Equal vectors travel once, with their number.
    found = sample.mapInArrow(vectors, "ids array<int>, values array<double>, grade int").groupBy("ids", "values", "grade").count().orderBy("grade", "ids", "values").toArrow().combine_chunks()
    lengths, grades, times = pc.list_value_length(found.column("ids")).to_numpy(), found.column("grade").to_numpy().copy(), found.column("count").to_numpy()
    ids, values = (found.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "values"))
    if grades.max() == 1:
        dense = values[np.cumsum(lengths) - 1]
        toxic = grades > 0
        grades[toxic] += dense[toxic] > np.sort(np.repeat(dense[toxic], times[toxic]))[times[toxic].sum() // 2]
    # Classes count as they stand in the labels.
    weigh = times * np.where(grades > 0, many[1] / per_class[True], many[0] / per_class[False])
    weights, thresholds = fit(ids, values, lengths, grades, weigh, len(index) + 1)
    return Ordinal(index, weights, thresholds)


def _share(wanted: int, many: int) -> int:
    """Of 2**20 hash values, so many that about ``wanted`` of ``many`` rows are taken."""
    return max(1, math.ceil((1 << 20) * min(1.0, wanted / many)))


def score(docs: DataFrame, model: Ordinal | None, *, id_col: str = "doc_id", text_col: str = "text", cutoff: float = 0.5) -> DataFrame:
    """id, ``p_toxic`` = P(grade > 0), ``severity`` (expected grade), ``grade`` (median), ``rejected`` (p_toxic >= cutoff)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if model is not None:
            claim_memory("toxicity", model.forms.clear)
        for batch in slices(batches):
            exceed = [np.zeros(1) if model is None else model.exceed(t or "") for t in batch.column(1).to_pylist()]
            first = np.array([round(float(e[0]), 9) for e in exceed])
            yield pa.record_batch(
                [
                    batch.column(0), pa.array(first), pa.array([round(float(e.sum()), 9) for e in exceed], pa.float64()),
                    pa.array([int((e >= 0.5).sum()) for e in exceed], pa.int32()), pa.array(first >= cutoff),
                ],
                names=["id", "p_toxic", "severity", "grade", "rejected"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, p_toxic double, severity double, grade int, rejected boolean").withColumnRenamed("id", id_col)


def kept(docs: DataFrame, model: Ordinal | None, *, text_col: str = "text", cutoff: float = 0.5) -> DataFrame:
    """``docs`` without the rows that ``score`` rejects."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if model is not None:
            claim_memory("toxicity", model.forms.clear)
        for batch in slices(batches):
            yield batch if model is None else batch.filter(pa.array([model.exceed(t or "")[0] < cutoff for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

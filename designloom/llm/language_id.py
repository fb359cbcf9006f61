"""Language identification by Kneser-Ney character models (operator 9).

One interpolated Kneser-Ney model per language predicts the characters of words
(letter runs in lower case, with a start and an end mark). Every n-gram's fully
interpolated probability is stored under a 64-bit hash in one sorted array per
order, every context's back-off weight likewise; the language is part of the
hash. The language with the lowest cross-entropy per character wins. The
confidence (a softmax over cross-entropies) and the rejection bar (a quantile of
the winners' cross-entropies) are calibrated on a part of the training sample
that the models have not counted.

Training reads a bounded sample (``docs_per_language``, by a hash of the id), one
row in ``CALIBRATING`` of which calibrates; prediction reads every letter of every
text. Letters are Unicode's: digits, fractions and circled numbers are none. Scores
of word forms are remembered per worker.

Defined cases: a null text, or one without letters, is ``und`` with score 0;
without any training document everything is ``und``; languages tie by name;
repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim_memory, letter_runs, slices

#: Longest n-gram.
ORDER = 4
#: Word forms that one Python worker remembers, how long they may be, and characters learnt at once.
CACHE_FORMS, LONG_FORM, LEARNED = 300_000, 64, 500_000
#: One of so many rows of the sample calibrates.
CALIBRATING = 8
START, END = 2, 3
UND = "und"


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all words with their marks, each one's place in its word, and its word."""
    marked = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return codes, place, owner


def _rolling(codes: np.ndarray, seed: np.ndarray | np.uint64) -> list[np.ndarray]:
    """Hashes of the last n characters at each position, n = 0 .. ORDER; those of n-1 one place before are the contexts."""
    out = [np.full(len(codes), 0, np.uint64) + seed]
    for n in range(ORDER):
        # The first of n characters starts from its own position's seed.
        before = np.concatenate([out[0][:1], out[-1][:-1]]) if n else out[0]
        out.append(_mix(before ^ (codes * np.uint64(0x9E3779B97F4A7C15))))
    return out


def _seed(language: int) -> np.uint64:
    return _mix(np.array([language + 1], np.uint64))[0]


def _one_language(seed: np.uint64, words: list[str], many: np.ndarray, alphabet: int) -> tuple[list, list]:
    """Interpolated probabilities of the n-grams of one language, and back-off weights of their contexts, by order."""
    codes, place, owner = _codes(words)
    weight = np.array(many, np.int64)[owner]
    rolls = _rolling(codes, seed)
    tables: list[tuple] = []
    # Which positions of each order are counted: predicted characters with n-1 before them.
    firsts: dict[int, np.ndarray] = {}
    for n in range(ORDER, 0, -1):
        at = np.flatnonzero((place >= n - 1) & (place > 0))
        keys, first, back = np.unique(rolls[n][at], return_index=True, return_inverse=True)
        position = at[first]
        raw = np.bincount(back, weight[at]).astype(np.float64)
        if n == ORDER:
            adjusted = raw
        else:
            # Distinct longer n-grams that end in this one; those at a word's start have none.
            longer = np.searchsorted(keys, rolls[n][firsts[n + 1]])
            adjusted = np.bincount(longer, minlength=len(keys)).astype(np.float64)
            starts = place[position] == n - 1
            adjusted[starts] = raw[starts]
        firsts[n] = position
        tables.append((n, keys, position, adjusted))
    grams: list = [None] * (ORDER + 1)
    contexts: list = [None] * (ORDER + 1)
    for n, keys, position, adjusted in reversed(tables):
        ones, twos = np.count_nonzero(adjusted == 1), np.count_nonzero(adjusted == 2)
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        context = rolls[n - 1][position - 1]
        spots, back = np.unique(context, return_inverse=True)
        total = np.bincount(back, adjusted)
        gamma = discount * np.bincount(back) / total
        lower = np.full(len(keys), 1 / alphabet)
        if n > 1:
            low_keys, low_chance = grams[n - 1]
            lower = low_chance[np.searchsorted(low_keys, rolls[n - 1][position])]
        grams[n] = keys, np.maximum(adjusted - discount, 0) / total[back] + gamma[back] * lower
        contexts[n] = spots, gamma
    return grams, contexts


@dataclass
class KneserNey:
    """Sorted hash arrays: ``grams[n]`` with interpolated probabilities, ``contexts[n]`` with back-off weights."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    unseen: float
    sharpness: float = 1.0
    bar: float = math.inf
    forms: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None
    used: int = 0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"forms": {}, "scores": None, "used": 0}

    @classmethod
    def train(cls, counts: Mapping[str, tuple[list[str], np.ndarray]]) -> KneserNey | None:
        """From the words of each language and their counts; a language is worked out at a time."""
        languages = sorted(counts)
        if not languages:
            return None
        alphabet = len({c for words, _ in counts.values() for w in words for c in w}) + 3
        parts = [_one_language(_seed(k), *counts[language], alphabet) for k, language in enumerate(languages)]
        tables = []
        for kind in range(2):
            merged: list = [None]
            for n in range(1, ORDER + 1):
                keys, values = (np.concatenate([p[kind][n][column] for p in parts]) for column in range(2))
                order = np.argsort(keys, kind="stable")
                merged.append((keys[order], values[order]))
            tables.append(merged)
        return cls(languages, *tables, 1 / alphabet)

    def log_chances(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of natural log probabilities per word and language, and characters predicted per word."""
        codes, place, owner = _codes(words)
        out = np.zeros((len(words), len(self.languages)))
        asked = place > 0
        order = np.minimum(place + 1, ORDER)
        for language in range(len(self.languages)):
            rolls = _rolling(codes, _seed(language))
            # Equal n-grams of equal order are looked up once.
            top = np.choose(order[asked] - 1, [r[asked] for r in rolls[1:]])
            _, first, back = np.unique(top, return_index=True, return_inverse=True)
            at = np.flatnonzero(asked)[first]
            chance, scale = np.full(len(at), self.unseen), np.ones(len(at))
            open_ = np.arange(len(at))
            for n in range(ORDER, 0, -1):
                here = open_[order[at[open_]] >= n]
                if not len(here):
                    continue
                keys, chances = self.grams[n]
                want = rolls[n][at[here]]
                spot = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = keys[spot] == want
                chance[here[hit]] = chances[spot[hit]]
                missed = here[~hit]
                keys, gammas = self.contexts[n]
                want = rolls[n - 1][at[missed] - 1]
                spot = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                seen = keys[spot] == want
                scale[missed[seen]] *= gammas[spot[seen]]
                done = np.zeros(len(at), bool)
                done[here[hit]] = True
                open_ = open_[~done[open_]]
            out[:, language] = np.bincount(owner[asked], np.log(chance * scale)[back], minlength=len(words))
        return out, np.bincount(owner[asked], minlength=len(words))

    def forget(self) -> None:
        self.forms.clear()
        self.scores, self.used = None, 0

    def learn(self, new: list[str]) -> None:
        """Remember the scores of new word forms (parts between white space)."""
        if self.scores is None:
            self.scores = np.zeros((1 << 16, len(self.languages) + 1), np.float32)
        while self.used + len(new) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        runs = [letter_runs(f.lower()) for f in new]
        words = [w for r in runs for w in r]
        row = np.repeat(np.arange(len(new)), [len(r) for r in runs])
        mine = self.scores[self.used : self.used + len(new)]
        mine[:] = 0
        if words:
            sums, sizes = self.log_chances(words)
            for k in range(len(self.languages)):
                mine[:, k] = np.bincount(row, sums[:, k], minlength=len(new))
            mine[:, -1] = np.bincount(row, sizes, minlength=len(new))
        self.forms.update(zip(new, range(self.used, self.used + len(new)), strict=True))
        self.used += len(new)

    def cross_entropies(self, texts: list[str | None]) -> np.ndarray:
        """Per text and language in nats a character; NaN without letters."""
        if self.used > CACHE_FORMS:
            self.forget()
        known, parts = self.forms, [(t or "").split() for t in texts]
        new, size, long_forms = [], 0, []
        for p in dict.fromkeys(p for ps in parts for p in ps if p not in known):
            new.append(p)
            if len(p) > LONG_FORM:
                long_forms.append(p)
            size += len(p)
            if size > LEARNED:
                self.learn(new)
                new, size = [], 0
        self.learn(new)
        out = np.full((len(texts), len(self.languages)), np.nan)
        for i, ps in enumerate(parts):
            sums = self.scores[np.fromiter(map(known.__getitem__, ps), np.int64, len(ps))].sum(axis=0, dtype=np.float64)
            if sums[-1]:
                out[i] = -sums[:-1] / sums[-1]
        for p in long_forms:
            del known[p]
        return out


def _posterior(entropies: np.ndarray, sharpness: float) -> np.ndarray:
    z = -sharpness * (entropies - np.nanmin(entropies, axis=1, keepdims=True))
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 2000, quantile: float = 0.999) -> KneserNey | None:
    """Fit on at most about ``docs_per_language`` rows of each language, a part of which only calibrates."""
    spark = docs.sparkSession
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    many = dict(known.groupBy("lang").count().collect())
    if not many:
        return None
    bars = F.create_map(*(F.lit(x) for lang, n in sorted(many.items()) for x in (lang, max(1, math.ceil((1 << 20) * min(1.0, docs_per_language / n))))))
    sample = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < bars[F.col("lang")])
    # A language of few rows has none to spare.
    spare = [lang for lang, n in many.items() if n >= 2 * CALIBRATING]
    held = F.col("lang").isin(spare) & (F.pmod(F.shiftright(F.xxhash64("id"), 20), F.lit(CALIBRATING)) == 0)
    counted, held = sample.where(~held).select("lang", "text"), sample.where(held).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], int] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word in letter_runs(text.lower()):
                    seen[lang, word] = seen.get((lang, word), 0) + 1
        keys = sorted(seen)
        for i in range(0, len(keys), 10_000):
            part = keys[i : i + 10_000]
            yield pa.record_batch([pa.array([k[0] for k in part]), pa.array([k[1] for k in part]), pa.array([seen[k] for k in part], pa.int64())], names=["lang", "word", "n"])

    found = counted.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    counts = {}
    for lang in pc.unique(found.column("lang")).to_pylist():
        mine = found.filter(pc.equal(found.column("lang"), lang)).sort_by("word")
        counts[lang] = mine.column("word").to_pylist(), mine.column("n").to_numpy()
    del found
    model = KneserNey.train(counts)
    if model is None:
        return None
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_memory("language", shared.value.forget)
        for batch in slices(batches):
            got = shared.value.cross_entropies(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(list(got), pa.list_(pa.float64()))], names=["lang", "entropies"])

    rows = [r for r in held.mapInArrow(measure, "lang string, entropies array<double>").collect() if not math.isnan(r.entropies[0])]
    # Without such rows (small tables) nothing is rejected.
    if rows:
        entropies = np.array([r.entropies for r in rows])
        truth = np.array([model.languages.index(r.lang) for r in rows])
        grid = [2.0**k for k in range(-2, 8)]
        loss = [-np.log(np.maximum(_posterior(entropies, s)[np.arange(len(truth)), truth], 1e-9)).mean() for s in grid]
        model.sharpness = grid[int(np.argmin(loss))]
        model.bar = float(np.quantile(entropies.min(axis=1), quantile))
    return model


def predict(docs: DataFrame, model: KneserNey | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``lang_pred``, ``score`` (0 to 1), ``cross_entropy`` (nats a character) and ``rejected`` (above the calibrated bar)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        claim_memory("language", model.forget if model else lambda: None)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            names, chances = [UND] * len(texts), np.zeros(len(texts))
            best, rejected = np.full(len(texts), np.nan), np.ones(len(texts), bool)
            if model is not None and texts:
                entropies = model.cross_entropies(texts)
                ok = ~np.isnan(entropies[:, 0])
                if ok.any():
                    win = entropies[ok].argmin(axis=1)
                    best[ok] = entropies[ok].min(axis=1)
                    chances[ok] = _posterior(entropies[ok], model.sharpness).max(axis=1)
                    rejected[ok] = best[ok] > model.bar
                    for i, k in zip(np.flatnonzero(ok), win, strict=True):
                        names[i] = model.languages[k]
            yield pa.record_batch(
                [batch.column(0), pa.array(names), pa.array(np.round(chances, 6)), pa.array(np.round(best, 6), from_pandas=True), pa.array(rejected)],
                names=["id", "lang_pred", "score", "cross_entropy", "rejected"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double, cross_entropy double, rejected boolean").withColumnRenamed("id", id_col)


def fold(id_col: str = "doc_id", folds: int = 4) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids have none."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds

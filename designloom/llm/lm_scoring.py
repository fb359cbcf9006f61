"""Cross-entropy difference by matched n-gram models (operator 1).

A target model (documents labelled good) and a background model (all others) are
word bigram models with one vocabulary, one smoothing and one set of n-grams;
they differ in their counts only. Each token's loss difference,
``log P_background - log P_target``, is averaged over a document: low scores look
like the target. A document's own words are left out of the counts that score it,
or those of its class would fit it for no other reason than that it is in it; so
what other documents repeat of it is what tells.

The models are whole: every word and every bigram of the corpus counts, at any
size, and no table of them is ever in one place. Texts become chunks of word
hashes in the shared folder. A chunk sends the counts of its n-grams (64-bit keys
of two 32-bit word hashes) to buckets by key; a bucket adds them up, and answers
each chunk with what the other chunks hold of the chunk's own n-grams, in their
order. So a frequent n-gram is one entry a chunk, and a chunk has the full counts
of all that its texts need. Buckets grow in number with the corpus.

``P(w) = (c(w) + 1) / (N + V + 1)`` with V the distinct words, and one more for an
unknown word; ``P(w | v) = (c(v w) + (r(v) + M) P(w)) / (c(v) + M)``, where c(v)
counts v, r(v) = c(v) less the bigrams that start with v, and M is ``strength``. In
the class of the document, c, r and N are those of all other documents; V is the
corpus's.

With explicit bounds (``vocabulary`` words, ``max_bigrams`` bigrams) the models are
cut to whole levels of the most frequent and broadcast, as sorted arrays; other
words are one unknown word, and a document's own words count. No query asks for
that.

Words are 32-bit hashes: two words of a corpus of V words share one with a chance
of about V / 2**32 each, and then count as one.

Defined cases: a null or empty text has no tokens, and null scores; labels that
are null, repeated (the largest counts) or of unknown documents do no harm; a
class without documents leaves its model uniform over the vocabulary; rows are
scored one by one, repeated ones alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim_memory, cut, drop_table, join_counted, slices, write_table

STRENGTH = 50.0
#: Hash values of the start of a text and of an unknown word; words have others.
START, UNKNOWN = 1, 2
#: Tokens counted at once in one task, and word hashes remembered by one worker.
CHUNK, CACHE_WORDS, LONG_WORD = 2_000_000, 300_000, 64
#: Tokens of one row of a chunk, and tokens of the corpus for each bucket.
PIECE, BUCKET_TOKENS = 200_000, 1_500_000
#: Rows of one Arrow batch of pieces or answers, which are large.
PIECE_ROWS = 16
#: An odd factor that spreads keys over buckets.
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = max(xxhash.xxh32_intdigest(word), UNKNOWN + 1)
        if len(self) < CACHE_WORDS and len(word) <= LONG_WORD:
            self[word] = value
        return value


_WORDS = _Words()


def tokens(text: str | None) -> np.ndarray:
    """32-bit hashes of the words of a text: parts between ASCII white space, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def _grams(words: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Keys of the bigrams that end in each word: left word in the high half."""
    left = np.concatenate([words[:1], words[:-1]])
    starts = np.concatenate([np.ones(min(1, len(words)), bool), owners[1:] != owners[:-1]])
    left[starts] = START
    return left << np.uint64(32) | words


def counts(docs: DataFrame) -> DataFrame:
    """``key, target, background`` of all unigrams (high half 0) and bigrams of ``text, target`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, bool]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            lengths = [len(w) for w, _ in held]
            words = np.concatenate([w for w, _ in held])
            owners = np.repeat(np.arange(len(held)), lengths)
            flags = np.repeat(np.array([t for _, t in held]), lengths)
            keys = np.concatenate([words, _grams(words, owners)])
            # The class travels in no spare bit: both classes are counted apart and meet in the sum.
            for target in (True, False):
                mine = keys[np.concatenate([flags, flags]) == target]
                if len(mine):
                    found, n = np.unique(mine, return_counts=True)
                    zero = np.zeros(len(n), np.int64)
                    for i in range(0, len(found), 50_000):
                        part = slice(i, i + 50_000)
                        both = (n[part], zero[part]) if target else (zero[part], n[part])
                        yield pa.record_batch([pa.array(found[part].view(np.int64)), *map(pa.array, both)], names=["key", "target", "background"])
            held.clear()

        for batch in slices(batches):
            for text, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = tokens(text)
                if len(words):
                    held.append((words, bool(target)))
                    size += len(words)
                if size >= CHUNK:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, "key long, target long, background long").groupBy("key").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def _most_frequent(table: DataFrame, most: int) -> DataFrame:
    """Rows with the largest totals, at most ``most``: whole levels of equal totals, found on a short histogram."""
    total = F.col("target") + F.col("background")
    # Exact totals up to 1024, sixteenths of an octave above.
    level = F.when(total <= 1024, total.cast("double")).otherwise(F.floor(F.log2(total) * 16) * 64 + 384.0)
    kept, bar = 0, None
    for row in sorted(table.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):
        if kept + row["count"] > most:
            break
        kept, bar = kept + row["count"], row.level
    return table.where(level >= bar) if bar is not None else table.limit(0)


@dataclass
class Models:
    """Both models: sorted keys, and a column of counts for each."""

    words: np.ndarray
    word_counts: np.ndarray
    grams: np.ndarray
    gram_counts: np.ndarray
    totals: np.ndarray
    rest: np.ndarray
    strength: float

    @classmethod
    def build(cls, words: np.ndarray, word_counts: np.ndarray, grams: np.ndarray, gram_counts: np.ndarray, totals: np.ndarray, strength: float) -> Models:
        """``words`` and ``grams`` are sorted keys; totals are all tokens of each class."""
        place = np.searchsorted(words, grams >> np.uint64(32))
        known = words[np.minimum(place, max(len(words) - 1, 0))] == grams >> np.uint64(32) if len(words) else np.zeros(len(grams), bool)
        kept = np.zeros((len(words), 2))
        for k in range(2):
            kept[:, k] = np.bincount(place[known], gram_counts[known, k], minlength=len(words))[: len(words)]
        return cls(words, word_counts, grams, gram_counts, totals, word_counts - kept, strength)

    def log_chances(self, text_words: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """Natural log probability of each token in (target, background)."""
        def find(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(keys):
                return np.zeros(len(wanted), bool), np.zeros((len(wanted), 2))
            spot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[spot] == wanted
            return hit, np.where(hit[:, None], values[spot], 0.0)

        unique, back = np.unique(text_words, return_inverse=True)
        known, count = find(self.words, unique, self.word_counts)
        _, rest = find(self.words, unique, self.rest)
        # What the vocabulary leaves over is the unknown word's.
        over = self.totals - self.word_counts.sum(axis=0)
        single = (np.where(known[:, None], count, over) + 1) / (self.totals + len(self.words) + 1)
        single, known_at, count_at, rest_at = single[back], known[back], count[back], rest[back]
        pairs, where = np.unique(_grams(text_words, owners), return_inverse=True)
        _, seen = find(self.grams, pairs, self.gram_counts)
        seen = seen[where]
        starts = np.concatenate([np.ones(min(1, len(owners)), bool), owners[1:] != owners[:-1]])
        left = np.concatenate([np.zeros(min(1, len(owners)), np.int64), np.arange(len(owners) - 1)])
        context, spare = count_at[left], rest_at[left]
        context[starts], spare[starts] = 0, 0
        usable = known_at & known_at[left] & ~starts
        seen[~usable] = 0
        return np.log((seen + (spare + self.strength) * single) / (context + self.strength))


def train(docs: DataFrame, *, vocabulary: int, max_bigrams: int, strength: float = STRENGTH) -> Models:
    """Both models from rows ``text, target``, cut to the bounds."""
    single = "key BETWEEN 0 AND 4294967295"
    table, path = write_table(counts(docs), "ngrams")
    unigrams, bigrams = table.where(single), table.where(f"NOT ({single})")
    sums = unigrams.agg(F.sum("target"), F.sum("background")).first()
    words = _most_frequent(unigrams, vocabulary).toArrow()

    def columns(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys = found.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        return keys[order], np.stack([found.column(c).to_numpy().astype(np.float64) for c in ("target", "background")], axis=1)[order]

    keys, word_counts = columns(words)
    # A bigram of kept words only; frequent bigrams have frequent words, so few are dropped after the cut.
    grams, gram_counts = columns(_most_frequent(bigrams, max_bigrams).toArrow())
    drop_table(docs.sparkSession, path)
    if len(keys):
        inside = [keys[np.minimum(np.searchsorted(keys, part), len(keys) - 1)] == part for part in (grams >> np.uint64(32), grams & np.uint64(0xFFFFFFFF))]
        grams, gram_counts = grams[inside[0] & inside[1]], gram_counts[inside[0] & inside[1]]
    return Models.build(keys, word_counts, grams, gram_counts, np.array([float(s or 0) for s in sums]), strength)


def score(docs: DataFrame, models: Models, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_tokens``, ``target_ce``, ``background_ce`` (nats a token) and ``score``, their difference."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = [tokens(t) for t in batch.column(1).to_pylist()]
            n = np.array([len(w) for w in words])
            owners = np.repeat(np.arange(len(words)), n)
            means = np.full((len(words), 2), np.nan)
            if n.sum():
                losses = -shared.value.log_chances(np.concatenate(words), owners)
                for k in range(2):
                    means[:, k] = np.where(n > 0, np.bincount(owners, losses[:, k], minlength=len(words)) / np.maximum(n, 1), np.nan)
            values = [np.round(means[:, 0], 6), np.round(means[:, 1], 6), np.round(means[:, 0] - means[:, 1], 6)]
            yield pa.record_batch([batch.column(0), pa.array(n), *(pa.array(v, from_pandas=True) for v in values)], names=["id", "n_tokens", "target_ce", "background_ce", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, target_ce double, background_ce double, score double").withColumnRenamed("id", id_col)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, bytes of one weight together, compressed."""
    return pa.compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, *types: type) -> list[np.ndarray]:
    widths = [np.dtype(t).itemsize for t in types]
    flat, out, at = np.frombuffer(pa.decompress(data, n * sum(widths), codec="zstd", asbytes=True), np.uint8), [], 0
    for kind, width in zip(types, widths, strict=True):
        out.append(np.ascontiguousarray(flat[at : at + n * width].reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


PIECES = "chunk long, part int, ids array<long>, lengths array<int>, targets array<boolean>, n long, n_target long, data binary"


def _pieces(docs: DataFrame) -> DataFrame:
    """Chunks of ``id, text, target`` rows, in pieces of whole texts that follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, part, size = TaskContext.get().partitionId() << 32, 0, 0
        held: list[tuple[int | None, np.ndarray, bool]] = []
        claim_memory("lm_scoring", _WORDS.clear)

        def flush() -> pa.RecordBatch:
            words = np.concatenate([w for _, w, _ in held]).astype(np.uint32)
            columns = [
                pa.array([chunk], pa.int64()), pa.array([part], pa.int32()), pa.array([[i for i, _, _ in held]], pa.list_(pa.int64())),
                pa.array([[len(w) for _, w, _ in held]], pa.list_(pa.int32())), pa.array([[t for _, _, t in held]], pa.list_(pa.bool_())),
                pa.array([len(words)], pa.int64()), pa.array([sum(len(w) for _, w, t in held if t)], pa.int64()), pa.array([_packed(words)], pa.binary()),
            ]
            held.clear()
            return pa.record_batch(columns, names=[c.split()[0] for c in PIECES.split(", ")])

        tokens_held = 0
        for batch in slices(batches):
            for i, text, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = tokens(text)
                held.append((i, words, bool(target)))
                # An empty text has a weight too.
                tokens_held += len(words) + 1
                size += len(words) + 1
                if tokens_held >= PIECE or size >= CHUNK:
                    yield flush()
                    part, tokens_held = part + 1, 0
                    if size >= CHUNK:
                        chunk, part, size = chunk + 1, 0, 0
        if held:
            yield flush()

    return cut(docs.mapInArrow(run, PIECES))


class _Chunk:
    """N-grams of a chunk: words under high half 0, last words of texts under low half 0, bigrams."""

    def __init__(self, pieces: list[dict], buckets: int) -> None:
        self.ids = [i for p in pieces for i in p["ids"]]
        self.lengths = np.array([n for p in pieces for n in p["lengths"]], np.int64)
        words = np.concatenate([_unpacked(p["data"], p["n"], np.uint32)[0] for p in pieces]).astype(np.uint64)
        self.owners = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        self.flags = np.array([t for p in pieces for t in p["targets"]], bool)
        flags = np.repeat(self.flags, self.lengths)
        #: Tokens that have a left neighbour, and last tokens of texts.
        self.later = np.flatnonzero(self.owners[1:] == self.owners[:-1]) + 1 if len(words) else np.zeros(0, np.int64)
        self.last = np.cumsum(self.lengths)[self.lengths > 0] - 1
        shift = np.uint64(32)
        # Each word has a key of the texts it ends, here or elsewhere.
        keys = np.concatenate([words, words[self.later - 1] << shift | words[self.later], np.unique(words) << shift])
        self.keys, place = np.unique(keys, return_inverse=True)
        del keys
        place = place.astype(np.int32)
        self.words, self.grams = place[: len(words)], place[len(words) : len(words) + len(self.later)]
        # Words are the first keys, in the order of their ends.
        self.ends = place[len(words) + len(self.later) :]
        counted = np.concatenate([self.words, self.grams, self.ends[self.words[self.last]]])
        both = np.bincount(counted, minlength=len(self.keys)).astype(np.uint32)
        target = np.bincount(counted[np.concatenate([flags, flags[self.later], flags[self.last]])], minlength=len(self.keys)).astype(np.uint32)
        self.counts = np.stack([target, both - target], axis=1)
        bucket = ((self.keys * SPREAD) >> shift) * np.uint64(buckets) >> shift
        #: Places of the n-grams by bucket and then key, and where buckets begin.
        self.order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable").astype(np.int32)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets))])

    def _own(self, places: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """How often each n-gram occurs in the text that it stands in."""
        _, back, many = np.unique(owners.astype(np.int64) * len(self.keys) + places, return_inverse=True, return_counts=True)
        return many[back]

    def scores(self, others: list[np.ndarray], n_words: int, totals: np.ndarray, strength: float) -> np.ndarray:
        """Mean loss of each text by (target, background); ``others``, of each class, by bucket and then key."""
        sums = np.zeros((len(self.lengths), 2))
        left = self.later - 1
        own_words, own_grams = self._own(self.words, self.owners), self._own(self.grams, self.owners[self.later])
        own_last = self.words == np.repeat(self.words[self.last], self.lengths[self.lengths > 0])
        for k in range(2):
            counts = self.counts[:, k].astype(np.float64)
            counts[self.order] += others[k]
            # What the text itself adds to its class.
            mine = self.flags if k == 0 else ~self.flags
            here = mine[self.owners]
            count, rest = counts[self.words] - here * own_words, counts[self.ends[self.words]] - (here & own_last)
            chance = (count + 1) / ((totals[k] + n_words + 1 - mine * self.lengths)[self.owners])
            given = chance.copy()
            seen = counts[self.grams] - here[self.later] * own_grams
            given[self.later] = (seen + (rest[left] + strength) * chance[self.later]) / (count[left] + strength)
            sums[:, k] = np.bincount(self.owners, -np.log(given), minlength=len(self.lengths))
        return sums / np.maximum(self.lengths, 1)[:, None]


def _chunks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple[int, _Chunk]]:
    """Chunks of a partition of pieces."""
    held: list[dict] = []
    for batch in slices(batches, PIECE_ROWS):
        for row in batch.to_pylist():
            if held and row["chunk"] != held[0]["chunk"]:
                yield held[0]["chunk"], _Chunk(held, buckets)
                held = []
            held.append(row)
    if held:
        yield held[0]["chunk"], _Chunk(held, buckets)


SCORES = "id long, n_tokens long, target_ce double, background_ce double, score double"


def _scored(ids: pa.Array, n: np.ndarray, means: np.ndarray) -> list[pa.Array]:
    means = np.where(n[:, None] > 0, means, np.nan)
    values = [np.round(means[:, 0], 6), np.round(means[:, 1], 6), np.round(means[:, 0] - means[:, 1], 6)]
    return [ids, pa.array(n, pa.int64()), *(pa.array(v, from_pandas=True) for v in values)]


def score_whole(docs: DataFrame, *, strength: float = STRENGTH) -> DataFrame:
    """Scores of ``id, text, target`` rows by models of all their n-grams."""
    spark = docs.sparkSession
    pieces = _pieces(docs)
    all_tokens, target_tokens = (int(n or 0) for n in pieces.agg(F.sum("n"), F.sum("n_target")).first())
    totals = np.array([target_tokens, all_tokens - target_tokens], np.float64)
    buckets = max(1, -(-all_tokens // BUCKET_TOKENS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_memory("lm_scoring counts", lambda: None)
        for name, chunk in _chunks(batches, buckets):
            for k in range(buckets if len(chunk.keys) else 0):
                mine = chunk.order[chunk.starts[k] : chunk.starts[k + 1]]
                # A bucket answers each chunk, even one that holds nothing of it: the words are counted so.
                data = _packed(np.diff(chunk.keys[mine], prepend=np.uint64(0)), *chunk.counts[mine].astype(np.uint32).T)
                yield pa.record_batch([pa.array([v], t) for v, t in ((name, pa.int64()), (k, pa.int32()), (len(mine), pa.int64()), (data, pa.binary()))], names=["chunk", "bucket", "n", "data"])

    def answer(table: pa.Table) -> pa.Table:
        # The words remembered for the pieces are of no use here.
        claim_memory("lm_scoring counts", lambda: None)
        sizes = table.column("n").to_pylist()
        held = [_unpacked(d, n, np.uint64, np.uint32, np.uint32) for d, n in zip(table.column("data").to_pylist(), sizes, strict=True)]
        keys, place = np.unique(np.concatenate([np.cumsum(h[0]) for h in held]), return_inverse=True)
        place = np.split(place, np.cumsum(sizes)[:-1])
        sums = np.zeros((2, len(keys)), np.int64)
        for spot, (_, *mine) in zip(place, held, strict=True):
            # Keys of one chunk are distinct.
            for k in range(2):
                sums[k, spot] += mine[k]
        words = int(np.searchsorted(keys, np.uint64(1 << 32)))
        data = [_packed(*(sums[k, spot] - mine[k] for k in range(2))) for spot, (_, *mine) in zip(place, held, strict=True)]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "n": table.column("n"), "words": pa.array([words] * len(data), pa.int64()), "data": pa.array(data, pa.binary())})

    def finish(table: pa.Table) -> pa.Table:
        claim_memory("lm_scoring counts", lambda: None)
        rows = table.to_pylist()
        chunk = _Chunk(sorted((r for r in rows if r["bucket"] is None), key=lambda r: r["part"]), buckets)
        answers = sorted((r for r in rows if r["bucket"] is not None), key=lambda r: r["bucket"])
        means = np.zeros((len(chunk.ids), 2))
        if answers:
            parts = [_unpacked(r["data"], r["n"], np.int64, np.int64) for r in answers]
            others = [np.concatenate([p[k] for p in parts]) for k in range(2)]
            means = chunk.scores(others, sum(r["words"] for r in answers), totals, strength)
        return pa.table(_scored(pa.array(chunk.ids, pa.int64()), chunk.lengths, means), names=[c.split()[0] for c in SCORES.split(", ")])

    counted = pieces.mapInArrow(count, "chunk long, bucket int, n long, data binary")
    answers = counted.groupBy("bucket").applyInArrow(answer, "chunk long, bucket int, n long, words long, data binary")
    return pieces.unionByName(answers, allowMissingColumns=True).groupBy("chunk").applyInArrow(finish, SCORES)


def cross_entropy_difference(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    strength: float = STRENGTH, vocabulary: int | None = None, max_bigrams: int | None = None,
) -> DataFrame:
    """Train on all ``docs``, target those whose label is 1, and score all of them; bounds cut the models."""
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("__id")).where("__id IS NOT NULL").distinct().withColumn("__target", F.lit(True))
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text"))
    rows = join_counted(rows, good, "__id", "left").select("__id", "text", F.coalesce("__target", F.lit(False)).alias("target"))
    if vocabulary is None and max_bigrams is None:
        return score_whole(rows, strength=strength).withColumnRenamed("id", id_col)
    if vocabulary is None or max_bigrams is None:
        raise ValueError("bounds come together: vocabulary and max_bigrams")
    return score(docs, train(rows.select("text", "target"), vocabulary=vocabulary, max_bigrams=max_bigrams, strength=strength), id_col=id_col, text_col=text_col)

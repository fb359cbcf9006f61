"""Embedding near-duplicates by cross-polytope hashing (operator 4).

Vectors are scaled to length one and rotated by random signs and fast Hadamard
transforms, three times over; the hash is the signed coordinate axis nearest to
the result. A table joins several such hashes, and every vector is put into its
own bucket and into ``PROBES`` more, reached by its next-nearest axes, so two
close vectors meet wherever their probe sets touch. Pairs that meet are verified
by cosine in double precision.

A table joins so many hashes that unrelated vectors seldom meet, by the number
of vectors; and there are so many tables that a pair at the bar meets in none
with a probability below ``MISS``, as seeded random pairs measure.

1. Equal vectors of a label collapse to their smallest id, and count by their
   number. The others are hashed once, into a table of the shared folder.
2. Bucket numbers and ids alone are grouped; vectors without company there go no
   further.
3. Each vector that has company is fetched once for each bucket where it has,
   and compared there. A bucket beyond ``block`` members is cut into blocks, and
   each pair of blocks is dealt to tasks by itself. A pair that meets in several
   buckets is counted in one only, the one of the smallest number. Tasks return
   counts, and links that span the components of a bucket, not pairs.

No link is below the bar; recall against brute force is measured in the tests.

Defined cases: rows whose label is null, and vectors that are null, empty, zero,
or hold null or non-finite components link with nothing (copies of them
included); vectors of different lengths never link; repeated rows count as
vectors of their own; a null id never links; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, drop_table, join_counted, slices, write_table

PROBES = 2
SEED = 20_240_601
#: Bound on the probability that a pair at the bar is missed, and random pairs that measure it.
MISS, TRIALS = 1e-4, 4000
#: Vectors hashed at once, members of a bucket that are compared at once, and rows of one comparison.
ROWS, BLOCK, STEP = 1000, 8192, 512
#: Buckets of up to so many members are compared together, by distance in their order.
FEW = 16


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, by steps of up to 16 points; their length is a power of two."""
    n, width, h = *x.shape, 1
    while h < width:
        points = min(16, width // h)
        step = _plain_hadamard(points)
        x = x.reshape(n, width // (points * h), points, h)
        x = (x.reshape(n, -1, points) @ step if h == 1 else step @ x).reshape(n, width)
        h *= points
    return x / np.sqrt(width)


@lru_cache(8)
def _plain_hadamard(points: int) -> np.ndarray:
    out = np.ones((1, 1))
    while len(out) < points:
        out = np.block([[out, out], [out, -out]])
    return out


def width_of(size: int) -> int:
    return 1 << max(1, (size - 1).bit_length())


def buckets(vectors: np.ndarray, tables: int, axes: int) -> np.ndarray:
    """Bucket numbers (64-bit) of each unit vector: shape (rows, tables, 1 + PROBES); the first is its own."""
    rows, size = vectors.shape
    width = width_of(size)
    padded = np.zeros((rows, width))
    padded[:, :size] = vectors
    random = np.random.default_rng(SEED + width)
    out = np.empty((rows, tables, 1 + PROBES), np.uint64)
    for t in range(tables):
        signs = random.choice((-1.0, 1.0), (axes, 3, width))
        best, second, gaps = (np.empty((rows, axes), kind) for kind in (np.uint64, np.uint64, np.float64))
        for k in range(axes):
            x = padded
            for turn in range(3):
                x = hadamard(x * signs[k, turn])
            size_of, at = np.abs(x), np.arange(rows)
            one = size_of.argmax(axis=1)
            gaps[:, k] = size_of[at, one]
            size_of[at, one] = -1
            two = size_of.argmax(axis=1)
            gaps[:, k] -= size_of[at, two]
            best[:, k], second[:, k] = 2 * one + (x[at, one] < 0), 2 * two + (x[at, two] < 0)
        # Each probe changes one hash to its second axis, the closest calls first.
        rank = np.argsort(gaps, axis=1, kind="stable")
        for p in range(1 + PROBES):
            mine = best.copy()
            if p:
                k = rank[:, (p - 1) % axes]
                mine[np.arange(rows), k] = second[np.arange(rows), k]
            code = np.full(rows, (t + 1) * 1_000_003 + size, np.uint64)
            for k in range(axes):
                code = mixed(code ^ mine[:, k])
            out[:, t, p] = code
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


@lru_cache(64)
def chosen(size: int, many: int, bar: float) -> tuple[int, int]:
    """Tables and axes for ``many`` vectors of ``size`` components."""
    cells = 2 * width_of(size)
    axes = max(1, math.ceil(math.log(max(1, (1 + PROBES) * many)) / math.log(cells)))
    # Pairs at the bar: a unit vector and one turned away from it by that angle.
    draws = np.random.default_rng(SEED)
    x = unit(draws.standard_normal((TRIALS, size)))
    y = draws.standard_normal((TRIALS, size))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    turned = bar * x + math.sqrt(max(0.0, 1 - bar * bar)) * (unit(y) if size > 1 else 0 * y)
    a, b = buckets(x, 1, axes)[:, 0], buckets(turned, 1, axes)[:, 0]
    missed = 1 - (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean()
    # One trial more that misses, so that luck promises nothing.
    missed = min(1 - 1e-3, missed + 1 / TRIALS)
    return max(2, math.ceil(math.log(MISS) / math.log(missed))), axes


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; by their largest component first, so that no square leaves the range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _first_common(keys: np.ndarray, i: np.ndarray, j: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Whether ``here`` is the smallest bucket that rows ``i`` and ``j`` share; keys of a row are sorted."""
    ok = np.ones(len(i), bool)
    for p in range(keys.shape[1]):
        x = keys[i, p]
        below = ok & (x < here)
        if not below.any():
            break
        at = np.flatnonzero(below)
        ok[at[(keys[j[at]] == x[at, None]).any(axis=1)]] = False
    return ok


class _Links:
    """Counts and spanning links of the buckets that one table of rows holds."""

    def __init__(self, nodes: np.ndarray, ids: np.ndarray, many: np.ndarray, vectors: np.ndarray, keys: np.ndarray, here: np.ndarray, bar: float) -> None:
        self.nodes, self.ids, self.many, self.vectors, self.keys, self.here, self.bar = nodes, ids, many, vectors, keys, here, bar
        self.counts, self.root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        self.spans: list[tuple[int, int]] = []

    def _find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Pairs of rows whose vectors are close enough."""
        for at in range(0, len(i), 100_000):
            a, b = i[at : at + 100_000], j[at : at + 100_000]
            first = _first_common(self.keys, a, b, self.here[a])
            a, b = a[first], b[first]
            np.add.at(self.counts, a, self.many[b])
            np.add.at(self.counts, b, self.many[a])
            for u, v in zip(a.tolist(), b.tolist(), strict=True):
                u, v = self._find(u), self._find(v)
                if u != v:
                    self.root[max(u, v)] = min(u, v)
                    self.spans.append((int(self.ids[u]), int(self.ids[v])))

    def few(self, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Many small buckets: rows at each distance from each other."""
        rows = np.concatenate([np.arange(s, s + n) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)])
        left = np.repeat(starts + sizes, sizes) - rows
        for d in range(1, int(sizes.max())):
            i = rows[left > d]
            for at in range(0, len(i), 20_000):
                a = i[at : at + 20_000]
                near = (self.vectors[a] * self.vectors[a + d]).sum(axis=1) >= self.bar
                self.add(a[near], a[near] + d)

    def block(self, start: int, stop: int, side: np.ndarray | None) -> None:
        """All pairs of a block, or those between its two sides."""
        for low in range(start, stop, STEP):
            high = min(low + STEP, stop)
            i, j = np.nonzero(self.vectors[low:high] @ self.vectors[low:stop].T >= self.bar)
            i, j = i + low, j + low
            ok = i < j if side is None else (i < j) & (side[i] != side[j])
            self.add(i[ok], j[ok])

    def table(self) -> pa.RecordBatch:
        some, n = np.flatnonzero(self.counts), len(self.spans)
        nothing = [None] * len(some)
        columns = [[*self.nodes[some].tolist(), *[None] * n], [*self.counts[some].tolist(), *[None] * n], [*nothing, *(s[0] for s in self.spans)], [*nothing, *(s[1] for s in self.spans)]]
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["node", "n", "a", "b"])


def _compared(met: DataFrame, kind: str, bar: float) -> DataFrame:
    """``node, n`` counts and ``a, b`` links of rows ``key, lo, hi, mine, label, node, id, many, body, keys``, dealt and sorted by key, lo and hi."""
    cell = np.dtype(np.float32 if kind == "float" else np.float64)

    def links(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        key, lo, hi, mine, nodes, ids, many = (table.column(c).to_numpy() for c in ("key", "lo", "hi", "mine", "node", "id", "many"))
        widths = np.array([len(b.as_buffer()) for b in table.column("body")]) // cell.itemsize
        label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        # Buckets hold one label and one length; a clash of bucket numbers parts here.
        order = np.lexsort((nodes, mine, label, widths, hi, lo, key))
        groups = np.stack([x[order] for x in (key, lo, hi, widths, label)])
        starts = np.flatnonzero(np.concatenate([[True], (groups[:, 1:] != groups[:, :-1]).any(axis=0)]))
        sizes = np.diff(np.concatenate([starts, [len(order)]]))
        bodies, codes = table.column("body"), table.column("keys")
        for width in np.unique(widths).tolist():
            picked = np.flatnonzero((groups[3][starts] == width) & (sizes > 1))
            if not len(picked):
                continue
            rows = np.concatenate([order[s : s + n] for s, n in zip(starts[picked].tolist(), sizes[picked].tolist(), strict=True)])
            vectors = np.frombuffer(b"".join(bodies[r].as_buffer() for r in rows.tolist()), cell).reshape(-1, width).astype(np.float64)
            keys = np.frombuffer(b"".join(codes[r].as_buffer() for r in rows.tolist()), np.int64).reshape(len(rows), -1)
            found = _Links(nodes[rows], ids[rows], many[rows], unit(vectors), keys, key[rows], bar)
            begins = np.cumsum(sizes[picked]) - sizes[picked]
            whole = (lo == hi)[rows][begins]
            few = (sizes[picked] <= FEW) & whole
            if few.any():
                found.few(begins[few], sizes[picked][few])
            sides = mine[rows]
            for s, n, one in zip(begins[~few].tolist(), sizes[picked][~few].tolist(), whole[~few].tolist(), strict=True):
                found.block(s, s + n, None if one else sides)
            yield found.table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in slices(batches, 2 * BLOCK):
            held.append(batch)
            size += batch.num_rows
            if size < 2 * BLOCK:
                continue
            # The last bucket's rows may go on in the next batch.
            last = held[-1]
            names = [last.column(c).to_numpy() for c in ("key", "lo", "hi")]
            same = np.logical_and.reduce([x == x[-1] for x in names])
            rest = last.num_rows - int(np.flatnonzero(~same)[-1]) - 1 if not same.all() else last.num_rows
            if rest < last.num_rows:
                yield from links([*held[:-1], last.slice(0, last.num_rows - rest)])
                held, size = [last.slice(last.num_rows - rest)], rest
        if held:
            yield from links(held)

    return met.mapInArrow(run, "node long, n long, a long, b long")


def near_vectors(
    table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", bar: float = 0.98, block: int = BLOCK
) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept``."""
    # Components of single precision stay so until they are compared.
    kind = "float" if table.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"))
    usable = F.expr("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL") & F.exists("vector", lambda x: x != 0)
    usable &= ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    # Copies collapse, -0.0 being 0.0; the other way round, rows find their class by 128 bits.
    able = rows.where("usable").withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0).cast(kind)))
    named = able.select("id", "label", "vector", F.xxhash64(F.lit(1), "label", "vector").alias("h"), F.xxhash64(F.lit(2), "label", "vector").alias("g"))
    classes = cut(named.groupBy("label", "vector", "h", "g").agg(F.min("id").alias("rep"), F.count("*").alias("many")))
    # Ids may repeat; numbers of the stored rows do not.
    classes = classes.withColumn("node", F.monotonically_increasing_id())
    spaces = {r.size: r.n for r in classes.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).collect()}
    plans = {size: chosen(size, n, bar) for size, n in spaces.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            vectors = batch.column(2)
            sizes = vectors.value_lengths().to_numpy()
            labels = batch.column(3).to_numpy().view(np.uint64)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(at))
                values = part.column(2).flatten().to_numpy().reshape(-1, size)
                # A bucket is one of its label.
                codes = mixed(buckets(unit(values.astype(np.float64)), *plans[size]).reshape(len(at), -1) ^ labels[at, None]).view(np.int64)
                codes.sort(axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)), pa.array(codes.ravel()))
                yield pa.record_batch(
                    [part.column(0), part.column(1), part.column(4), part.column(5), pa.array([v.tobytes() for v in values], pa.binary()), lists, pa.array([c.tobytes() for c in codes], pa.binary())],
                    names=["id", "many", "label", "node", "body", "codes", "keys"],
                )

    schema = "id long, many long, label string, node long, body binary, codes array<long>, keys binary"
    hashed, path = write_table(classes.select("rep", "many", "vector", F.xxhash64("label").alias("space"), "label", "node").mapInArrow(place, schema), "hashed")
    spots = hashed.select("node", F.explode(F.array_distinct("codes")).alias("key"))
    company = spots.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    met = spots.join(company, "key").withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    met = met.withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = met.withColumn("other", other).select("node", "key", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    met = met.join(hashed.select("node", "id", "many", "label", "body", "keys"), "node")
    met = met.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    links = cut(_compared(met, kind, bar))
    counts = links.where("n IS NOT NULL").groupBy("node").agg(F.sum("n").alias("n"))
    found = connected_components(links.where("n IS NULL").select("a", "b")).withColumnRenamed("node", "rep")
    # Only vectors with copies or links need telling; all others stand alone.
    told = classes.select("h", "g", "node", "rep", "many").join(counts, "node", "left").join(found, "rep", "left").drop("node")
    told = cut(told.where("many > 1 OR n IS NOT NULL OR component IS NOT NULL"))
    joined = join_counted(named.select("id", "h", "g"), told, ["h", "g"], "left")
    linked = joined.select("id", (F.coalesce("many", F.lit(1)) - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep", "id").alias("component_id"))
    # Rows that can't link keep a row of their own.
    others = rows.where("NOT usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = cut(linked.union(others).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")))
    drop_table(table.sparkSession, path)
    return out

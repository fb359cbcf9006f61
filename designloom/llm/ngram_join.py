"""N-gram Jaccard join by signature trees (operator 3).

No link at or above the threshold is lost, none below it is made, up to clashes of
hashes: shingles are 64-bit hashes, of which 48 bits are stored and compared, so a
pair of sets of n shingles is misjudged with a probability below n*n / 2**48; equal
sets are told by a 128-bit digest.

1. Each text becomes its set of shingle hashes, stored in the shared folder. Equal
   sets collapse to the smallest id before anything is compared, so groups of
   copies, however large, cost one row each in what follows.
2. Sets meet where they share a token of their *prefix*, the few tokens that any
   partner of sufficient overlap must touch, in one order of all tokens. The
   order puts a fixed share of hash space first, and there rare tokens before
   frequent ones, by their exact frequency: these tokens alone are counted, in
   one shuffle. A token of one set can't be met, so most sets send nothing on.
3. The sets that meet at a token form a signature tree, all trees of a task being
   traversed together: a node holds the OR of the bitmaps below and the range of
   sizes, and a pair of nodes is dropped if its largest possible overlap is below
   what its smallest sizes ask for. Sets that can link, directly or through others,
   form a block; each block travels once to one task.
4. A block becomes a signature tree of its whole sets, and pairs of documents that
   its traversal leaves, and that are not joined already, are decided on their sets.
   A block beyond ``block_tokens`` is sorted by size and least token and cut into
   slices, the leaves of a tree of the whole block; a pair of slices that the
   traversal leaves becomes a task of its own. More than ``TREED`` sets that meet
   at one token go to one such block together, their trees being those of slices.

Defined cases: null, empty and blank texts have the empty set and no links; a
text of fewer words than a shingle is one shingle; repeated rows keep one row
each; a null id never links; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim_memory, connected_components, cut, drop_table, join_counted, slices, write_table

#: Words whose hashes one Python worker remembers.
CACHE_WORDS, LONG_WORD = 400_000, 64
#: The counted share of hash space, as a multiple of the prefix's share of a set.
REGION = 1.5
#: Documents of one leaf of a block's tree, and children of one inner node.
LEAF, FANOUT = 8, 4
#: Sets that meet at one token of which all pairs that can link are told; of more, links that span them; beyond, they are one block.
PAIRED, TREED = 48, 8192
#: Bits of the bitmaps that travel with meetings, at least and at most.
LEAST_SKETCH_BITS, MOST_SKETCH_BITS = 256, 2048
#: Tokens of the sets that one task holds at once.
BLOCK_TOKENS = 6_000_000
#: Bits of the widest bitmap.
MAX_BITS = 1 << 15


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= LONG_WORD:
            if len(self) > CACHE_WORDS:
                self.clear()
            self[word] = value
        return value


_WORDS = _Words()


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles of a text.

    ``bytes`` methods touch ASCII only: lower() maps A-Z, split() cuts at
    U+0020 and U+0009 to U+000D.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(k, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= codes[i : len(codes) - width + 1 + i]
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0x165667B19E3779F9)
    out ^= out >> np.uint64(32)
    # Distinct by all 64 bits; in the order of the 48 that are stored.
    return np.unique((out << np.uint64(16)) | (out >> np.uint64(48)))


def pack(tokens: np.ndarray) -> bytes:
    """The low 48 bits of sorted hashes, as six byte planes: the high ones compress well."""
    return np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, 2:].T).tobytes()


def unpack(data: pa.Buffer) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :6] = planes.T
    return out.view(np.uint64).ravel()


def sketch_bits(size: int) -> int:
    """A bit per token: a power of two."""
    return min(MOST_SKETCH_BITS, max(LEAST_SKETCH_BITS, 1 << max(size - 1, 0).bit_length()))


def bitmap(tokens: np.ndarray, width: int) -> np.ndarray:
    """Bits of the hashes' low ends, in 64-bit words; ``fold`` halves the width."""
    bits = np.zeros(width, np.uint8)
    bits[((tokens >> np.uint64(16)) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def prefix_length(size: int, num: int, den: int) -> int:
    """Tokens of a set that every partner at Jaccard >= num/den must touch one of."""
    return size - -(-num * size // den) + 1 if size else 0


def linked(size_a: int, size_b: int, shared: int, num: int, den: int) -> bool:
    return den * shared >= num * (size_a + size_b - shared)


# Stage 1: sets, in one pass over the texts.


def region(tokens: np.ndarray, num: int, den: int) -> int:
    """How many of the sorted tokens, by their 48 stored bits, are in the counted share of hash space."""
    share = min(1.0, REGION * (den - num) / den)
    return int(np.searchsorted(tokens >> np.uint64(16), np.uint64(int(share * ((1 << 48) - 1)))))


def _sets(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """``id, n, sig, tokens, bits, region`` per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_memory("ngram_join", _WORDS.clear)
        for batch in slices(batches):
            rows = [shingles(t, k) for t in batch.column(1).to_pylist()]
            yield pa.record_batch(
                [
                    batch.column(0), pa.array([len(r) for r in rows], pa.int64()), pa.array([xxhash.xxh3_128_digest(r) for r in rows], pa.binary()),
                    pa.array([pack(r) for r in rows], pa.binary()), pa.array([bitmap(r, sketch_bits(len(r))).tobytes() for r in rows], pa.binary()),
                    pa.array([region(r, num, den) for r in rows], pa.int64()),
                ],
                names=["id", "n", "sig", "tokens", "bits", "region"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n long, sig binary, tokens binary, bits binary, region long")


# Stage 2: where sets meet.


def _counted(reps: DataFrame, num: int, den: int) -> DataFrame:
    """``token, node, forced``: all tokens of the counted region; forced ones fill up a prefix that the region leaves short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            picked, forced, n = [], [], []
            for cells, inside in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                # Sorted, so the region comes first, and what fills it up next.
                tokens = unpack(cells.as_buffer())
                size = max(inside, prefix_length(len(tokens), num, den))
                picked.append(tokens[:size])
                forced.append(np.arange(size) >= inside)
                n.append(size)
            if sum(n):
                yield pa.record_batch(
                    [pa.array(np.concatenate(picked).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(np.concatenate(forced))], names=["token", "node", "forced"]
                )

    return reps.select("id", "tokens", "region").mapInArrow(run, "token long, node long, forced boolean")


def _complete(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of at least about ``rows`` sorted rows, cut between tokens."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            tokens = table.column("token").to_numpy()
            # The last token's rows may go on in the next batch.
            end = int(np.searchsorted(tokens, tokens[-1], side="left"))
            held, size = table.slice(end).to_batches(), len(tokens) - end
            if end:
                yield table.slice(0, end).combine_chunks()
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _shared(counted: DataFrame) -> DataFrame:
    """``token, node, forced, many`` of the tokens that two or more sets hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_memory("blocks", lambda: None)
        for table in _complete(batches, 100_000):
            tokens = table.column("token").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            many = np.diff(np.concatenate([starts, [len(tokens)]]))
            many = np.repeat(many, many)
            kept = table.append_column("many", pa.array(many)).filter(pa.array(many > 1))
            yield from kept.to_batches()

    spark = counted.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return counted.repartition(parts, "token").sortWithinPartitions("token").mapInArrow(run, "token long, node long, forced boolean, many long")


def _meetings(reps: DataFrame, shared: DataFrame, num: int, den: int) -> DataFrame:
    """``token, node, n, bits``: the shared tokens that are in their set's prefix."""
    # Of the prefix, tokens that no other set holds come first; shared ones of the region follow by frequency.
    own = Window.partitionBy("node")
    ranked = shared.select(
        "*", F.row_number().over(own.orderBy("forced", "many", "token")).alias("rank"), F.sum(F.when(F.col("forced"), 0).otherwise(1)).over(own).alias("common")
    )
    faces = reps.select(F.col("id").alias("node"), "n", "bits", "region")
    met = ranked.join(faces, "node")
    prefix = F.col("n") - F.ceil(F.col("n") * num / F.lit(den)) + 1
    met = met.where(F.col("forced") | (F.col("rank") <= prefix - (F.col("region") - F.col("common"))))
    return met.select("token", "node", "n", "bits")


# Stage 3: which sets that meet can link.


def _folded(bits: list[pa.Scalar], rows: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps of ``rows`` at ``width`` bits; wider ones are folded by OR."""
    out = np.empty((len(rows), width // 64), np.uint64)
    for k, r in enumerate(rows.tolist()):
        words = np.frombuffer(bits[r].as_buffer(), np.uint64)
        out[k] = words if len(words) == out.shape[1] else np.bitwise_or.reduce(words.reshape(-1, out.shape[1]), axis=0)
    return out


def forest_pairs(groups: np.ndarray, sizes: np.ndarray, bits: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group that can link: a dual traversal of the signature trees of all groups at once.

    ``groups`` are sorted.
    """
    order = np.lexsort((bits[:, 0], sizes, groups))
    level = bits[order], sizes[order], sizes[order], np.bitwise_count(bits[order]).sum(axis=1, dtype=np.int64)
    levels, spans, owner = [level], [], groups
    while True:
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        many = np.diff(np.concatenate([first, [len(owner)]]))
        if many.max() == 1:
            break
        cuts = np.flatnonzero((np.arange(len(owner)) - np.repeat(first, many)) % FANOUT == 0)
        spans.append((cuts, np.concatenate([cuts[1:], [len(owner)]])))
        level = tuple(f.reduceat(x, cuts, axis=0) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.minimum), level, strict=True))
        levels.append(level)
        owner = owner[cuts]
    a = b = np.arange(len(owner))
    for depth in range(len(levels) - 1, -1, -1):
        ok = possible_pairs(levels[depth], a, b, num, den)
        a, b = a[ok], b[ok]
        if depth:
            starts, stops = spans[depth - 1]
            kids = np.arange(FANOUT)
            x = (starts[a][:, None, None] + kids[None, :, None]).repeat(FANOUT, axis=2)
            y = (starts[b][:, None, None] + kids[None, None, :]).repeat(FANOUT, axis=1)
            ok = (x < stops[a][:, None, None]) & (y < stops[b][:, None, None]) & ((x < y) if depth == 1 else (x <= y))
            # Children of two nodes are cut by their groups' order, so x is left of y unless the nodes are one.
            a, b = x[ok], y[ok]
    return order[a], order[b]


def _group_edges(tokens: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, bits: list[pa.Scalar], num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges between sets that meet at a token and can link; rows are sorted by token, groups complete."""
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    many = np.diff(np.concatenate([starts, [len(tokens)]]))
    group, many_of = np.repeat(np.arange(len(many)), many), np.repeat(many, many)
    widths = np.array([len(b.as_buffer()) * 8 for b in bits])
    for g in np.flatnonzero(many > TREED).tolist():
        rows = np.arange(starts[g] + 1, starts[g] + many[g])
        yield np.full(len(rows), nodes[starts[g]]), nodes[rows]
    for width in np.unique(widths).tolist():
        own = widths == width
        # Sets that link have equal or neighbouring widths, as have those that a wider one may reach.
        rows = np.flatnonzero((own | (widths == 2 * width) & (num * sizes <= den * width)) & (many_of <= TREED))
        company = np.bincount(group[rows], minlength=len(many)) > 1
        company &= np.bincount(group[rows], own[rows], minlength=len(many)) > 0
        few = rows[(company & (many <= PAIRED))[group[rows]]]
        if len(few):
            i, j = forest_pairs(group[few], sizes[few], _folded(bits, few, width), num, den)
            i, j = few[i], few[j]
            ok = own[i] | own[j]
            yield nodes[i[ok]], nodes[j[ok]]
        for g in np.flatnonzero(company & (many > PAIRED) & (many <= TREED)).tolist():
            mine = rows[np.searchsorted(rows, starts[g]) : np.searchsorted(rows, starts[g] + many[g])]
            links = tree_links(nodes[mine], None, num, den, sizes=sizes[mine], bits=_folded(bits, mine, width))
            yield np.array([x[0] for x in links], np.int64), np.array([x[1] for x in links], np.int64)


def _edges(met: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b`` edges of ``token, node, n, bits`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _complete(batches, 20_000):
            bits = list(table.column("bits").combine_chunks())
            for a, b in _group_edges(*(table.column(c).to_numpy() for c in ("token", "node", "n")), bits, num, den):
                if len(a):
                    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                    yield pa.record_batch([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    spark = met.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(parts, "token").sortWithinPartitions("token").mapInArrow(run, "a long, b long").where("a <> b").distinct()


# Stage 4: trees.


class Block:
    """Sets of one block with token bitmaps; a bitmap has about four bits per token of the largest set."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray] | None, sizes: np.ndarray | None = None, bits: np.ndarray | None = None) -> None:
        if sets is None:
            order = np.argsort(sizes, kind="stable")
            self.ids, self.sizes, self.order, self.sets, self.bits = ids[order], sizes[order], order, None, bits[order]
            self.count = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
            return
        sizes = np.array([len(s) for s in sets])
        # Documents of like size, and then of like least token, share a leaf.
        order = np.lexsort((np.array([int(s[0]) for s in sets], np.uint64), np.floor(np.log(sizes) * 20)))
        self.ids, self.sizes, self.order = ids[order], sizes[order], order
        self.sets = [sets[i] for i in order]
        width = min(MAX_BITS, 1 << int(4 * int(sizes.max()) - 1).bit_length()) // 64 or 1
        self.bits = np.zeros((len(sets), width), np.uint64)
        for row, tokens in zip(self.bits, self.sets, strict=True):
            row[:] = bitmap(tokens << np.uint64(16), 64 * width)
        self.count = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)


class Tree:
    """Levels of nodes over a block; node ``i`` of a level spans children ``FANOUT*i`` and on.

    A node holds the OR of the bitmaps below, the range of sizes, and the least
    number of bits.
    """

    def __init__(self, level: tuple[np.ndarray, ...], step: int = LEAF) -> None:
        """``level``: the ``bits, low, high, count`` of what leaves of ``step`` hold."""
        self.levels: list[tuple[np.ndarray, ...]] = []
        while not self.levels or len(level[1]) > 1:
            cuts = np.arange(0, len(level[1]), step)
            level = tuple(f.reduceat(x, cuts, axis=0) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.minimum), level, strict=True))
            self.levels.append(level)
            step = FANOUT

    def possible(self, depth: int, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
        """Whether node pairs can hold a link."""
        return possible_pairs(self.levels[depth], a, b, num, den)

    def open_pairs(self, num: int, den: int, to: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of nodes of level ``to`` that the traversal leaves, ``a <= b``."""
        depth = len(self.levels) - 1
        a = b = np.zeros(1, np.int64)
        while True:
            ok = self.possible(depth, a, b, num, den)
            a, b = a[ok], b[ok]
            if depth == to:
                return a, b
            depth -= 1
            many = len(self.levels[depth][1])
            kids = np.arange(FANOUT)
            x = (a[:, None, None] * FANOUT + kids[None, :, None]).repeat(FANOUT, axis=2).ravel()
            y = (b[:, None, None] * FANOUT + kids[None, None, :]).repeat(FANOUT, axis=1).ravel()
            ok = (x <= y) & (x < many) & (y < many)
            a, b = x[ok], y[ok]


def possible_pairs(level: tuple[np.ndarray, ...], a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether pairs of nodes ``bits, low, high, count`` can hold a link."""
    bits, low, high, count = level
    found = np.zeros(len(a), bool)
    ok = np.flatnonzero(den * np.minimum(high[a], high[b]) >= num * np.maximum(low[a], low[b]))
    step = max(1, (1 << 20) // bits.shape[1])
    for i in range(0, len(ok), step):
        part = ok[i : i + step]
        x, y = a[part], b[part]
        common = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64)
        found[part] = may_link(low[x], high[x], count[x], low[y], high[y], count[y], common, num, den)
    return found


def may_link(low_a, high_a, count_a, low_b, high_b, count_b, common, num: int, den: int):  # noqa: ANN001, ANN201
    """Largest possible overlap against what the smallest sizes ask for.

    Every bit that a set has and the other side has not stands for a token that
    is not shared; a link of sizes x and y shares ``num*(x+y)/(num+den)``.
    """
    most = np.minimum(high_a - np.maximum(count_a - common, 0), high_b - np.maximum(count_b - common, 0))
    return (num + den) * most >= num * (low_a + low_b)


class Union:
    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.root[max(i, j)] = min(i, j)
        return i != j

    def flat(self) -> np.ndarray:
        while (up := self.root[self.root]).tobytes() != self.root.tobytes():
            self.root = up
        return self.root


def tree_links(
    ids: np.ndarray, sets: list[np.ndarray] | None, num: int, den: int, side: np.ndarray | None = None, *, sizes: np.ndarray | None = None, bits: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Links that span the components of a block, by a dual traversal of its tree.

    With ``side`` (0 or 1 per set) only links between different sides count.
    Without ``sets``, ``sizes`` and ``bits`` tell which pairs can link, and those count.
    """
    if len(ids) < 2:
        return []
    block = Block(ids, sets, sizes, bits)
    sides = None if side is None else side[block.order]
    tree, union, out = Tree((block.bits, block.sizes, block.sizes, block.count)), Union(len(ids)), []
    a, b = tree.open_pairs(num, den)
    cuts = np.arange(0, len(ids), LEAF)
    # Near pairs of leaves first: they join most documents, and later pairs can be skipped.
    size, count, bits = block.sizes, block.count, block.bits
    for p in _near_first(a, b, cuts, union):
        rows = np.arange(a[p] * LEAF, min((a[p] + 1) * LEAF, len(ids)))
        cols = np.arange(b[p] * LEAF, min((b[p] + 1) * LEAF, len(ids)))
        root = union.flat()
        open_ = (root[rows][:, None] != root[cols][None, :]) & (rows[:, None] < cols[None, :])
        if sides is not None:
            open_ &= sides[rows][:, None] != sides[cols][None, :]
        open_ &= den * np.minimum(size[rows][:, None], size[cols][None, :]) >= num * np.maximum(size[rows][:, None], size[cols][None, :])
        i, j = np.nonzero(open_)
        i, j = rows[i], cols[j]
        for at in range(0, len(i), 128):
            x, y = i[at : at + 128], j[at : at + 128]
            common = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64)
            ok = may_link(size[x], size[x], count[x], size[y], size[y], count[y], common, num, den)
            for u, v in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                if union.find(u) == union.find(v):
                    continue
                if block.sets is None:
                    union.join(u, v)
                    out.append((int(block.ids[u]), int(block.ids[v])))
                    continue
                shared = len(np.intersect1d(block.sets[u], block.sets[v], assume_unique=True))
                if linked(len(block.sets[u]), len(block.sets[v]), shared, num, den):
                    union.join(u, v)
                    out.append((int(block.ids[u]), int(block.ids[v])))
    return out


def _near_first(a: np.ndarray, b: np.ndarray, cuts: np.ndarray, union: Union) -> Iterator[int]:
    """Leaf pairs by distance, without those whose documents are all joined by then."""
    order = np.argsort(b - a, kind="stable")
    ends = np.flatnonzero(np.diff((b - a)[order], append=-1)) + 1
    for begin, end in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
        mine, root = order[begin:end], union.flat()
        low, high = np.minimum.reduceat(root, cuts), np.maximum.reduceat(root, cuts)
        yield from mine[np.minimum(low[a[mine]], low[b[mine]]) != np.maximum(high[a[mine]], high[b[mine]])].tolist()


def _block_links(rows: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b`` links of the rows ``key, side, id, tokens``; a key is a block or a pair of slices."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        claim_memory("blocks", lambda: None)
        ids = table.column("id").to_numpy()
        sets = [unpack(c.as_buffer()) for c in table.column("tokens")]
        sides = table.column("side").to_numpy()
        both = set(sides.tolist()) - {-1}
        links = tree_links(ids, sets, num, den, sides if len(both) == 2 else None)
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return rows.groupBy("key").applyInArrow(run, "a long, b long")


def _sliced(members: DataFrame, most: int) -> DataFrame:
    """``block, slice, id, n, tokens``: blocks by size and least token, cut at about ``most`` tokens."""

    def face(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            least = [int(unpack(c.as_buffer())[0]) for c in batch.column(3)]
            band = np.floor(np.log(batch.column(2).to_numpy()) * 20).astype(np.int32)
            yield pa.record_batch([*batch.columns, pa.array(band), pa.array(least, pa.int64())], names=["block", "id", "n", "tokens", "band", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, before = TaskContext.get().partitionId() << 32, 0, None
        for batch in slices(batches):
            out = []
            for block, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if before is not None and (block != before or held + n > most):
                    number, held = number + 1, 0
                before, held = block, held + n
                out.append(number)
            yield pa.record_batch([batch.column(0), pa.array(out, pa.int64()), *(batch.column(k) for k in (1, 2, 3))], names=["block", "slice", "id", "n", "tokens"])

    faces = members.select("block", "id", "n", "tokens").mapInArrow(face, "block long, id long, n long, tokens binary, band int, least long")
    dealt = faces.repartitionByRange("block", "band", "least", "id").sortWithinPartitions("block", "band", "least", "id")
    return dealt.mapInArrow(run, "block long, slice long, id long, n long, tokens binary")


def _slice_pairs(sliced: DataFrame, num: int, den: int) -> DataFrame:
    """``slice, side, key`` of the slices alone, and of pairs that the tree of their block leaves."""

    def faces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            number, first = np.unique(batch.column(1).to_numpy(), return_index=True)
            rows = {s: ([], []) for s in number.tolist()}
            for s, n, cells in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                rows[s][0].append(n)
                rows[s][1].append(bitmap(unpack(cells.as_buffer()) << np.uint64(16), MAX_BITS))
            count = [min(int(np.bitwise_count(b).sum()) for b in rows[s][1]) for s in number.tolist()]
            whole = [np.bitwise_or.reduce(rows[s][1]).tobytes() for s in number.tolist()]
            low, high = ([f(rows[s][0]) for s in number.tolist()] for f in (min, max))
            yield pa.record_batch([batch.column(0).take(pa.array(first)), pa.array(number), *(pa.array(x, pa.int64()) for x in (low, high, count)), pa.array(whole, pa.binary())], names=["block", "slice", "low", "high", "count", "bits"])

    def pairs(key: tuple, table: pa.Table) -> pa.Table:
        number, low, high, count = (table.column(c).to_numpy() for c in ("slice", "low", "high", "count"))
        bits = np.stack([np.frombuffer(c.as_buffer(), np.uint64) for c in table.column("bits")])
        order = np.argsort(number, kind="stable")
        names, cuts = np.unique(number[order], return_index=True)
        level = tuple(f.reduceat(x[order], cuts, axis=0) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.minimum), (bits, low, high, count), strict=True))
        a, b = Tree(level, 1).open_pairs(num, den)
        apart = a != b
        a, b = a[apart], b[apart]
        alone = np.arange(len(names))
        x, y = names[np.concatenate([alone, a, b])], names[np.concatenate([alone, a, a])]
        z, side = names[np.concatenate([alone, b, b])], np.concatenate([np.full(len(names), -1), np.zeros(len(a), int), np.ones(len(b), int)])
        return pa.table({"slice": pa.array(x), "side": pa.array(side, pa.int32()), "key": pa.array([f"s{p}:{q}" for p, q in zip(y.tolist(), z.tolist(), strict=True)])})

    summaries = sliced.mapInArrow(faces, "block long, slice long, low long, high long, count long, bits binary")
    return cut(summaries.groupBy("block").applyInArrow(pairs, "slice long, side int, key string"))


def _tasks(blocks: DataFrame, num: int, den: int, limit: int) -> DataFrame:
    """Rows ``key, side, id, tokens`` of the tasks of ``blocks`` (``block, id, n, tokens``).

    A block within ``limit`` tokens is one task. A larger one is cut into slices
    of a third of the limit, each alone and in the pairs that can hold a link.
    """
    sizes = blocks.groupBy("block").agg(F.sum("n").alias("total"))
    large = cut(sizes.where(F.col("total") > limit).select("block"))
    alone = (F.concat(F.lit("b"), F.col("block")).alias("key"), F.lit(-1).alias("side"), "id", "tokens")
    if not large.limit(1).count():
        return blocks.select(*alone)
    small = join_counted(blocks, large, "block", "left_anti").select(*alone)
    sliced = cut(_sliced(join_counted(blocks, large, "block", "left_semi"), limit // 3))
    return small.union(sliced.join(_slice_pairs(sliced, num, den), "slice").select("key", "side", "id", "tokens"))


def near_components(
    docs: DataFrame,
    *,
    k: int = 5,
    num: int = 80,
    den: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``class_id``, ``component_id``.

    Documents link at Jaccard >= num/den of their ``k``-word shingle sets;
    ``class_id`` is the smallest id with the same set.
    """
    spark = docs.sparkSession
    stored, path = write_table(_sets(docs, k, num, den, id_col, text_col), "shingles")
    able = stored.where("n > 0 AND id IS NOT NULL")
    # Most sets stand alone; only those held twice are looked up.
    twice = cut(able.groupBy("sig").agg(F.min("id").alias("class_id"), F.count("*").alias("many")).where("many > 1").select("sig", "class_id"))
    member = join_counted(stored.select("id", "n", "sig"), twice, "sig", "left")
    member = cut(member.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("class_id", "id")).otherwise(F.col("id")).alias("class_id")))
    # Copies go; rows that repeat an id are harmless below.
    reps = join_counted(able, member.where("id <> class_id").select("id").distinct(), "id", "left_anti")
    shared, shared_path = write_table(_shared(_counted(reps, num, den)), "shared")
    met = _meetings(reps, shared, num, den).distinct()
    edges = cut(_edges(met, num, den))
    blocks = connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("block"))
    # An id that is repeated with several sets keeps one of them.
    sets = join_counted(reps, blocks, "id", "inner").groupBy("block", "id").agg(F.max_by("n", "sig").alias("n"), F.max_by("tokens", "sig").alias("tokens"))
    # Stored, so that no task needs two Python workers: an executor keeps all that it once had.
    links = cut(_block_links(_tasks(sets, num, den, block_tokens), num, den))
    found = connected_components(links)
    out = join_counted(member, found.withColumnRenamed("node", "class_id"), "class_id", "left")
    out = cut(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", F.coalesce("component", "class_id").alias("component_id")))
    drop_table(spark, path)
    drop_table(spark, shared_path)
    return out

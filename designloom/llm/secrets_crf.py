"""Secret scans: fixed patterns and a linear-chain conditional random field (operator 2).

Patterns find the *base* spans. A CRF tags tokens as secret begin, inside or
outside by their shape, neighbouring words and file features, and is decoded by
Viterbi; its spans that touch no base span are added as kind ``crf``.

Any token may begin a secret, of any length and any characters: the weights alone
decide. Whole texts are tokenised and scored, with the five tokens before across
line ends. Viterbi runs where it can matter: where no span inside a stretch without
white space can gain on leaving it outside, by a bound on scores and moves, all of
it is outside in the best path, which so falls into parts decoded one by one.

The CRF is trained here, on what the patterns label in a bounded sample of
documents (``sample_docs``, chosen by a hash of the id): on stretches around
labelled tokens and around long tokens of digits and letters, and on about
``ORDINARY`` stretches of any text.

Defined cases: a null text counts as empty, and has no spans; repeated rows are
scanned alike; without any labelled token (an empty table too) the CRF adds
nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim_memory, slices

# The base patterns, and the least length of what they match.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

#: White space, and a token.
TOKEN = re.compile(r"(\s*)([A-Za-z0-9+/_=-]+|[^\sA-Za-z0-9+/_=-])")
SPACED = re.compile(r"\s*(?:[A-Za-z0-9+/_=-]+|[^\sA-Za-z0-9+/_=-])")
KEYWORDS = re.compile(r"(?ai)pass|pwd|secret|token|key|auth|cred|bearer|private|access")
#: Tokens before one that its features look at, and tokens around a marked one that are trained on.
BEFORE, AROUND = 5, 12
#: Stretches of any text in training, at most about; tokens scored at once; tokens remembered by one worker.
ORDINARY, BLOCK, CACHE = 2_000, 1 << 16, 100_000
HEXES = frozenset("0123456789abcdefABCDEF")
O, B, I = 0, 1, 2  # noqa: E741

Span = tuple[str, int, int]


def _long_parts(text: str, least: int) -> Iterator[tuple[str, int]]:
    """Parts between white space of at least ``least`` characters, with their offsets."""
    at = 0
    for part in [p for p in text.split() if len(p) >= least]:
        at = text.index(part, at)
        yield part, at
        at += len(part)


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start and then kind."""
    out: list[Span] = []
    if "=" in text or ":" in text:
        at = 0
        # No match crosses a line.
        for line in text.split("\n"):
            if "=" in line or ":" in line:
                for m in ASSIGN.finditer(line):
                    if len(m[2]) >= ASSIGN_LEAST:
                        out.append(("assign", at + m.start(), at + m.end()))
            at += len(line) + 1
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    for part, at in _long_parts(text, HEX_LEAST):
        out += [("hex", at + m.start(), at + m.end()) for m in HEX.finditer(part)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def tokenise(text: str) -> list[tuple[str, int]]:
    """Tokens of a text, and their offsets."""
    return [(m[2], m.start(2)) for m in TOKEN.finditer(text)]


_ASCII_KINDS = {c: "d" if chr(c).isdigit() else "A" if chr(c).isupper() else "a" if chr(c).isalpha() else "-" for c in range(128)}


def _kinds(token: str) -> str:
    if token.isascii():
        return token.translate(_ASCII_KINDS)
    return "".join("d" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "-" for c in token)


@lru_cache(1 << 14)
def _shape(kinds: str) -> str:
    return re.sub(r"(.)\1+", r"\1+", kinds)[:12]


@lru_cache(1 << 14)
def _entropy(counts: tuple[int, ...]) -> float:
    return -sum(c / sum(counts) * math.log2(c / sum(counts)) for c in counts)


def file_features(text: str) -> list[str]:
    lines = text.count("\n") + 1
    marks = text.count("=") + text.count(":") + text.count("{")
    return [f"file:len{min(6, int(math.log10(len(text) + 1)))}", f"file:marks{min(4, 4 * marks // lines)}"]


def _own(token: str) -> list[str]:
    """Feature names that depend on the token alone."""
    names, n, kinds = ["bias"], len(token), _kinds(token)
    if n >= 6:
        # Tokens of more than one character are ASCII.
        counts = sorted(map(token.count, set(token)))
        digits, upper, lower = kinds.count("d"), kinds.count("A"), kinds.count("a")
        marks, lines = "+" in token or "/" in token or "=" in token, "_" in token or "-" in token
        names += [
            f"mixed{0 < digits and 0 < upper + lower:d}{n >= 16:d}", f"len{min(12, n // 4)}", f"entropy{int(2 * _entropy(tuple(counts)))}", f"digits{8 * digits // n}",
            f"kinds{upper > 0:d}{lower > 0:d}{marks:d}{lines:d}", f"hex{HEXES.issuperset(token):d}",
            f"start{token[:4]}" if token[:4].isupper() else "startlow", f"distinct{len(counts) // 4}",
        ]
        if "=" in token and KEYWORDS.search(token):
            names.append("assigned")
    names.append(f"shape{_shape(kinds)}" if n < 16 else "shapelong")
    return names


def _low(token: str) -> str:
    return token.lower() if len(token) < 16 else "<long>"


def _as_left(token: str) -> str:
    return f"prev{'<word>' if token.isalnum() else _low(token)}"


def _as_right(token: str) -> str:
    return "next" if token.isalnum() else f"next{_low(token)}"


def features(tokens: list[tuple[str, int]], of_file: list[str], low: int = 0, high: int | None = None) -> list[list[str]]:
    """Feature names of the tokens from ``low`` to ``high``, by all that stand around them."""
    out = []
    for i in range(low, len(tokens) if high is None else high):
        token, at = tokens[i]
        names = [*_own(token), *of_file, _as_left(tokens[i - 1][0]) if i else "prev", _as_right(tokens[i + 1][0]) if i + 1 < len(tokens) else "next"]
        if any(KEYWORDS.search(_low(w)) for w, _ in tokens[max(0, i - BEFORE) : i]):
            names.append("keyword")
        if i and tokens[i - 1][1] + len(tokens[i - 1][0]) == at:
            names.append("glued")
        out.append(names)
    return out


class Crf:
    """Linear-chain CRF over tags O, B, I; I only follows B or I, without white space before it."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray) -> None:
        self.index, self.weights, self.moves = index, weights, moves
        self._scanner: _Scanner | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_scanner": None}

    def scanner(self) -> _Scanner:
        if self._scanner is None:
            self._scanner = _Scanner(self)
        return self._scanner

    @staticmethod
    def _barred() -> np.ndarray:
        barred = np.zeros((3, 3))
        barred[O, I] = -1e9
        return barred

    def scores(self, rows: list[list[int]], glued: list[bool]) -> np.ndarray:
        out = np.stack([self.weights[r].sum(axis=0) if r else np.zeros(3) for r in rows])
        out[~np.array(glued), I] = -1e9
        return out

    def decode(self, scores: np.ndarray) -> list[int]:
        """Viterbi."""
        moves = self.moves + self._barred()
        best, back = scores[0].copy(), []
        best[I] = -1e9
        for row in scores[1:]:
            ways = best[:, None] + moves
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + row
        tags = [int(best.argmax())]
        for step in reversed(back):
            tags.append(int(step[tags[-1]]))
        return tags[::-1]

    def _marginals(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chances of tags (sequence, token, tag), and sums of those of moves, of padded sequences."""
        moves = self.moves + self._barred()
        many, longest = scores.shape[:2]
        fore, aft = np.empty_like(scores), np.zeros_like(scores)
        fore[:, 0] = scores[:, 0]
        fore[:, 0, I] = -1e9
        for t in range(1, longest):
            fore[:, t] = np.logaddexp.reduce(fore[:, t - 1, :, None] + moves, axis=1) + scores[:, t]
        for t in range(longest - 2, -1, -1):
            ahead = np.logaddexp.reduce(moves + (scores[:, t + 1] + aft[:, t + 1])[:, None, :], axis=2)
            aft[:, t] = np.where((t < lengths - 1)[:, None], ahead, 0.0)
        total = np.logaddexp.reduce(fore[np.arange(many), lengths - 1], axis=1)
        nodes = np.exp(fore + aft - total[:, None, None])
        inside = np.arange(longest)[None, :] < lengths[:, None]
        nodes[~inside] = 0
        way = fore[:, :-1, :, None] + moves + (scores[:, 1:] + aft[:, 1:])[:, :, None, :] - total[:, None, None, None]
        return nodes, np.exp(way[inside[:, 1:]]).sum(axis=0)

    @classmethod
    def train(cls, data: list[tuple[list[list[str]], list[int]]], *, epochs: int = 12, batch: int = 8, rate: float = 0.3, decay: float = 1e-4) -> Crf | None:
        """Maximum likelihood by AdaGrad over batches of sequences of (feature names, tags) of like length, in a fixed shuffled order."""
        if not any(t != O for _, tags in data for t in tags):
            return None
        counts = Counter(n for names, _ in data for row in names for n in row)
        index = {n: i for i, n in enumerate(sorted(n for n, c in counts.items() if c >= 3))}
        model = cls(index, np.zeros((len(index), 3)), np.zeros((3, 3)))
        square_w, square_m = np.full(model.weights.shape, 1e-6), np.full((3, 3), 1e-6)
        batches = []
        by_length = sorted(range(len(data)), key=lambda k: len(data[k][1]))
        for at in range(0, len(data), batch):
            mine = [data[k] for k in by_length[at : at + batch]]
            lengths = np.array([len(tags) for _, tags in mine])
            coded = [model.code(names) for names, _ in mine]
            # Cells: tokens of the padded batch; features of each cell.
            cell = np.concatenate([k * lengths.max() + np.arange(n) for k, n in enumerate(lengths.tolist())])
            rows = [r for found, _ in coded for r in found]
            flat, owner = np.array([i for r in rows for i in r], np.int64), np.repeat(cell, [len(r) for r in rows])
            touched, place = np.unique(flat, return_inverse=True)
            apart = cell[~np.array([g for _, glued in coded for g in glued], bool)]
            tags = np.array([t for _, ts in mine for t in ts])
            follows = np.concatenate([np.arange(1, n) + low for low, n in zip((np.cumsum(lengths) - lengths).tolist(), lengths.tolist(), strict=True)])
            batches.append((lengths, cell, owner, touched, place, apart, tags, follows))
        order = np.random.default_rng(0)
        for _ in range(epochs):
            for b in order.permutation(len(batches)):
                lengths, cell, owner, touched, place, apart, tags, follows = batches[b]
                cells, weights = len(lengths) * int(lengths.max()), model.weights[touched]
                scores = np.stack([np.bincount(owner, weights[place, k], minlength=cells) for k in range(3)], axis=1)
                scores[apart, I] = -1e9
                nodes, pairs = model._marginals(scores.reshape(len(lengths), -1, 3), lengths)
                slope = nodes.reshape(-1, 3)
                slope[cell, tags] -= 1
                np.add.at(pairs, (tags[follows - 1], tags[follows]), -1)
                grad = np.stack([np.bincount(place, slope[owner, k], minlength=len(touched)) for k in range(3)], axis=1) + decay * weights
                square_w[touched] += grad**2
                model.weights[touched] -= rate * grad / np.sqrt(square_w[touched])
                square_m += pairs**2
                model.moves -= rate * pairs / np.sqrt(square_m)
        return model

    def code(self, names: list[list[str]]) -> tuple[list[list[int]], list[bool]]:
        rows = [[self.index[n] for n in row if n in self.index] for row in names]
        return rows, ["glued" in row for row in names]

    def tag(self, names: list[list[str]]) -> list[int]:
        return self.decode(self.scores(*self.code(names)))

    def weight(self, names: list[str]) -> np.ndarray:
        return sum((self.weights[self.index[n]] for n in names if n in self.index), np.zeros(3))


class _Scanner(dict):
    """Spans of whole texts: what a token adds to scores is remembered by token, with the white space before it."""

    def __init__(self, model: Crf) -> None:
        super().__init__()
        self.model = model
        self.first, self.last = model.weight(["prev"]), model.weight(["next"])
        self.keyword, self.glued = model.weight(["keyword"]), model.weight(["glued"])
        moves = model.moves
        #: The most that moves can add to a span: as it begins and ends, and for each token inside.
        self.ends = max(0.0, *(moves[a, B] - moves[a, O] for a in (O, B, I))) + max(0.0, *(moves[a, c] - moves[O, c] for a in (B, I) for c in (O, B)))
        self.inner = max(moves[B, I], moves[I, I]) - moves[O, O]
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.weights: dict[tuple[str, ...], np.ndarray] = {}
        #: Own scores, those of the token after it, those of the token before it; length with white space, white space, keyword.
        self.known, self.sizes = np.zeros((1024, 3, 3)), np.zeros((1024, 3), np.int64)

    def __missing__(self, spaced: str) -> int:
        at, token = len(self), spaced.lstrip()
        if at == len(self.known):
            self.known, self.sizes = np.concatenate([self.known, np.zeros_like(self.known)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.known[at] = self._weight(*_own(token)), self._weight(_as_left(token)), self._weight(_as_right(token))
        self.sizes[at] = len(spaced), len(spaced) - len(token), KEYWORDS.search(_low(token)) is not None
        self[spaced] = at
        return at

    def _weight(self, *names: str) -> np.ndarray:
        found = self.weights.get(names)
        if found is None:
            found = self.weights[names] = self.model.weight(list(names))
        return found

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Spans of the best path of a whole text."""
        if len(self) > CACHE:
            self.forget()
        ids = np.fromiter((self[m[0]] for m in SPACED.finditer(text)) if len(text) > 1 << 24 else map(self.__getitem__, SPACED.findall(text)), np.int32)
        n = len(ids)
        if not n:
            return []
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes[:, 0])
        glued = sizes[:, 1] == 0
        glued[0] = False
        near = np.concatenate([[0], np.cumsum(sizes[:, 2])])
        near = near[:-1] > near[np.maximum(np.arange(n) - BEFORE, 0)]
        of_file = self.model.weight(file_features(text))
        starts = np.flatnonzero(~glued)
        borders = [*np.unique(starts[np.searchsorted(starts, np.arange(0, starts[-1] + 1, BLOCK))]).tolist(), n]
        out: list[tuple[int, int]] = []
        held: list[np.ndarray] = []
        begin = 0

        def settle(until: int) -> None:
            if held:
                scores = np.concatenate(held)
                if begin:
                    scores[0] += self.model.moves[O]
                if until < n:
                    scores[-1] += self.model.moves[:, O]
                start = None
                for t, tag in zip(range(begin, until + 1), [*self.model.decode(scores), O], strict=True):
                    if tag != I and start is not None:
                        out.append((start, int(ends[t - 1])))
                        start = None
                    if tag == B:
                        start = int(ends[t] - sizes[t, 0] + sizes[t, 1])
                held.clear()

        for low, high in zip(borders, borders[1:]):
            scores = self.known[ids[low:high], 0] + of_file
            scores += np.concatenate([self.known[ids[low - 1 : high - 1], 1] if low else np.concatenate([self.first[None], self.known[ids[: high - 1], 1]])])
            scores += self.known[ids[low + 1 : high + 1], 2] if high < n else np.concatenate([self.known[ids[low + 1 :], 2], self.last[None]])
            scores += near[low:high, None] * self.keyword + glued[low:high, None] * self.glued
            scores[~glued[low:high], I] = -1e9
            groups = np.flatnonzero(~glued[low:high])
            more = np.maximum(scores[:, I] - scores[:, O] + self.inner, 0.0)
            sums = np.cumsum(more)
            stops = np.append(groups[1:], high - low)
            after = np.repeat(sums[stops - 1], stops - groups) - sums
            open_ = np.maximum.reduceat(scores[:, B] - scores[:, O] + self.ends + after, groups) > -1e-6
            last = 0 if held else -1
            for g in np.flatnonzero(open_).tolist():
                if last != groups[g] or not held:
                    settle(low + last)
                    begin = low + int(groups[g])
                held.append(scores[groups[g] : stops[g]])
                last = int(stops[g])
            # A part that reaches the border goes on behind it.
            if held and (last != high - low or high == n):
                settle(low + last)
        return out


def labelled(text: str, ordinary: float = 0.0) -> list[tuple[list[list[str]], list[int]]]:
    """Training sequences of a text, with the tags that the base spans give their tokens; of a share of texts, a stretch of any kind."""
    spans = []
    for kind, start, end in base_spans(text):
        if kind == "assign":
            start = end - len(ASSIGN.match(text[start:end])[2])
        spans.append((start, end))
    dice = zlib.crc32(text.encode("utf-8", "replace"))
    if dice >= ordinary * 2**32 and not spans and not any(_is_long(part) for part, _ in _long_parts(text, 16)):
        return []
    tokens, tags, inside, k = tokenise(text), [], None, 0
    spans.sort()
    for i, (token, at) in enumerate(tokens):
        while k < len(spans) and spans[k][1] <= at:
            k += 1
        hit = next((s for s in spans[k:] if s[0] < at + len(token) and at < s[1]), None) if k < len(spans) and spans[k][0] < at + len(token) else None
        follows = i > 0 and tokens[i - 1][1] + len(tokens[i - 1][0]) == at
        tags.append(O if hit is None else I if hit == inside and follows else B)
        inside = hit
    marked = [i for i, (token, _) in enumerate(tokens) if tags[i] != O or _is_long(token)]
    if tokens and dice < ordinary * 2**32:
        marked.append(dice % len(tokens))
        assigns = [i for i, (token, _) in enumerate(tokens) if token in "=:\"'"]
        marked += [assigns[dice % len(assigns)]] if assigns else []
    ranges: list[list[int]] = []
    for i in sorted(marked):
        low, high = max(0, i - AROUND), min(len(tokens), i + AROUND + 1)
        if ranges and low <= ranges[-1][1]:
            ranges[-1][1] = max(high, ranges[-1][1])
        else:
            # A span is whole.
            while low and tags[low] == I:
                low -= 1
            ranges.append([low, high])
    of_file = file_features(text)
    return [(features(tokens, of_file, low, high), tags[low:high]) for low, high in ranges]


def _is_long(token: str) -> bool:
    return len(token) >= 16 and any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


def spans_of(text: str, model: Crf | None) -> list[Span]:
    """Base spans, and those the CRF adds."""
    base = base_spans(text)
    if model is None:
        return base
    added = [("crf", start, end) for start, end in model.scanner().spans(text) if not any(s < end and start < e for _, s, e in base)]
    return sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))


def join(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each stretch that spans cover replaced by ``mark``."""
    out, at = [], 0
    merged: list[list[int]] = []
    for _, s, e in spans:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 20_000) -> Crf | None:
    """Train on at most about ``sample_docs`` documents that the hash of the id chooses."""
    many = docs.count()
    if not many:
        return None
    ordinary = min(1.0, ORDINARY / min(many, sample_docs))
    kept = docs.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < max(1, math.ceil((1 << 20) * min(1.0, sample_docs / many))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_memory("secrets", lambda: None)
        for batch in slices(batches):
            data = [json.dumps(found) for t in batch.column(0).to_pylist() if t and (found := labelled(t, ordinary))]
            yield pa.record_batch([pa.array(data, pa.string())], names=["data"])

    # Only the tagged stretches travel; sorting them makes the training order fixed.
    rows = kept.select(F.col(text_col).alias("text")).mapInArrow(run, "data string").collect()
    return Crf.train([(names, tags) for data in sorted(r[0] for r in rows) for names, tags in json.loads(data)])


def scan(docs: DataFrame, model: Crf | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``spans array<struct<kind, start, end>>`` of each row, by start and then kind."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            claim_memory("secrets", shared.value.scanner().forget if shared.value else lambda: None)
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t or "", shared.value)] for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, kind)], names=["id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, spans array<struct<kind:string,start:long,end:long>>").withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, model: Crf | None, *, text_col: str = "text") -> DataFrame:
    """``docs`` with secrets replaced in the text; null stays null."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            claim_memory("secrets", shared.value.scanner().forget if shared.value else lambda: None)
            texts = [None if t is None else redact(t, spans) if (spans := spans_of(t, shared.value)) else t for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def digest(spans: DataFrame) -> DataFrame:
    """Counts and digests of the spans that ``scan`` returns."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return spans.select(
        spans.columns[0],
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.concat_ws(",", F.transform(base, text)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", text)).alias("spans"),
    )


def sha256_of(spans: list[Span]) -> str:
    return hashlib.sha256(join(spans).encode()).hexdigest()

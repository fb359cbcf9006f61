"""SentencePiece encoding and decoding with byte offsets (operator 7).

The model file is read directly: its compiled character map (a double-array
trie over UTF-8 prefixes and a table of replacements) drives a longest-prefix
normaliser that records, for each normalised byte, the original bytes it came
from: stretches that no key of the map begins in stay as they are, and are aligned
at once. Every text passes through it, and each of its pieces is projected through
the alignment to a span of the original bytes. A model with an empty map (as the
query's) leaves all characters but spaces alone. Ids are the library's.

Where the model has no character map and no piece joins a word to a following
space, the library gets texts beyond ``LONG_TEXT`` characters in stretches, cut at
single spaces, which encode independently: its memory then stays bounded. All
other texts are encoded whole.

Defined cases: a null text counts as empty; an empty text has no ids; one row
per input row, repeated ones included; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SPACE = "▁"
SPACE_BYTES = SPACE.encode()
#: Characters that the library encodes at once, where a text can be cut.
LONG_TEXT = 1 << 20
#: A space that stands alone between other characters.
SINGLE_SPACE = re.compile(r"(?<=[^ ]) (?=[^ ])")


class CharacterMap:
    """The compiled map of a normaliser: longest matching prefix to its replacement."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.texts = blob[4 + size :]
        root = self._offset(self.units[0])
        #: Bytes that begin a key.
        self.firsts = [b for b in range(1, 256) if (root ^ b) < len(self.units) and self.units[root ^ b] & 0x800000FF == b]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at ``at``, and its replacement."""
        units, found = self.units, None
        node = self._offset(units[0])
        for end in range(at, len(data)):
            byte = data[end]
            if not byte:
                break
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = end + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        length, start = found
        return length, self.texts[start : self.texts.index(b"\0", start)]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 1 << 9) >> 6)


@dataclass
class Encoding:
    ids: np.ndarray
    #: Spans of the original text in UTF-8 bytes; byte pieces of one replacement share its span.
    starts: np.ndarray
    ends: np.ndarray
    id_text: str
    decoded: str


class Codec:
    def __init__(self, model_path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as f:
            proto.ParseFromString(f.read())
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        rules = proto.normalizer_spec
        self.rules = rules
        self.map = CharacterMap(rules.precompiled_charsmap) if rules.precompiled_charsmap else None
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        kinds = type(proto.pieces[0])
        self.bytes_of = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.decimals = [str(i) for i in range(len(proto.pieces))]
        self.unknown = proto.trainer_spec.unk_id
        #: User-defined pieces are kept as they are by the normaliser.
        self.kept = sorted((p.piece.encode() for p in proto.pieces if p.type == kinds.USER_DEFINED), key=len, reverse=True)
        crossing = any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces)
        self.divisible = (
            self.map is None and not self.kept and not crossing and not self.suffix
            and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
        )
        self.firsts = self._first_bytes()

    # Normalising with alignment.

    def normalise(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Normalised bytes, and for each of them where its original bytes begin and end."""
        data, rules = text.encode(), self.rules
        raw = np.frombuffer(data, np.uint8)
        replaced: list[tuple[int, int, bytes]] = []
        at = 0
        for spot in np.flatnonzero(self.firsts[raw]).tolist() if self.firsts is not None else ():
            # A byte that begins a key begins a character too.
            if spot >= at:
                length, new = self._step(data, spot)
                at = spot + length
                if new != data[spot:at]:
                    replaced.append((spot, at, new))
        out, begins = raw, np.arange(len(raw))
        ends = begins + 1
        if replaced:
            chunks, at = [], 0
            for begin, end, new in replaced:
                chunks += [(raw[at:begin], begins[at:begin], ends[at:begin]), (np.frombuffer(new, np.uint8), np.full(len(new), begin), np.full(len(new), end))]
                at = end
            chunks.append((raw[at:], begins[at:], ends[at:]))
            out, begins, ends = (np.concatenate(c) for c in zip(*chunks, strict=True))
        if rules.remove_extra_whitespaces and len(out):
            # The first of each run of spaces stays, unless nothing stands before or after it.
            kept = (out != 32) | np.concatenate([[False], out[:-1] != 32])
            if out[-1] == 32:
                kept[np.flatnonzero(kept)[-1:]] &= out[np.flatnonzero(kept)[-1:]] != 32
            out, begins, ends = out[kept], begins[kept], ends[kept]
        if not len(out):
            return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
        if rules.add_dummy_prefix:
            # One space more, of no original bytes.
            edge = ends[-1:] if self.suffix else begins[:1]
            spaced = [(np.full(1, 32, np.uint8), edge, edge), (out, begins, ends)]
            out, begins, ends = (np.concatenate(c) for c in zip(*(spaced[::-1] if self.suffix else spaced), strict=True))
        if rules.escape_whitespaces:
            copies = np.where(out == 32, len(SPACE_BYTES), 1)
            return out.tobytes().replace(b" ", SPACE_BYTES), np.repeat(begins, copies), np.repeat(ends, copies)
        return out.tobytes(), begins, ends

    def _first_bytes(self) -> np.ndarray | None:
        """Which bytes begin what the normaliser must look at; None if there are none."""
        firsts = {p[0] for p in self.kept} | set(self.map.firsts if self.map else ())
        return np.isin(np.arange(256), sorted(firsts)) if firsts else None

    def _step(self, data: bytes, at: int) -> tuple[int, bytes]:
        for piece in self.kept:
            if data.startswith(piece, at):
                return len(piece), piece
        if self.map is not None and (hit := self.map.longest(data, at)) is not None:
            return hit
        lead = data[at]
        length = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return length, data[at : at + length]

    # Encoding.

    def encode(self, text: str) -> Encoding:
        normal, begins, ends = self.normalise(text)
        ids: list[int] = []
        decoded = []
        for stretch in self._stretches(text):
            mine = self.processor.encode(stretch)
            ids += mine
            decoded.append(self.processor.decode(mine))
        cells = np.array(ids, np.int32)
        lengths = self.bytes_of[cells]
        if self.unknown in ids:
            # An unknown piece is as long as what it stands for.
            names = [p for stretch in self._stretches(text) for p in self.processor.encode(stretch, out_type=str)]
            lengths = np.array([len(p.encode()) if i == self.unknown else n for i, p, n in zip(ids, names, lengths.tolist(), strict=True)], np.int64)
        stops = np.cumsum(lengths)
        if (int(stops[-1]) if ids else 0) != len(normal):
            raise ValueError("pieces do not cover the normalised text")
        decimals = self.decimals
        return Encoding(cells, begins[stops - lengths], ends[stops - 1], ",".join([decimals[i] for i in ids]), " ".join(decoded))

    def _stretches(self, text: str) -> Iterator[str]:
        """The text, or what stands between some of its single spaces: each space is the mark before what follows."""
        at = 0
        if self.divisible and len(text) > LONG_TEXT and SPACE not in text and "\0" not in text:
            while len(text) - at > LONG_TEXT and (found := SINGLE_SPACE.search(text, at + LONG_TEXT)):
                yield text[at : found.start()]
                at = found.end()
        yield text[at:] if at else text

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids)


@functools.lru_cache(maxsize=2)
def shared_codec(model_path: str) -> Codec:
    """One codec per Python worker."""
    return Codec(model_path)


def encode(docs: DataFrame, *, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``ids``, ``starts``, ``ends`` (UTF-8 byte spans of the pieces) and ``decoded`` of each text."""
    schema = "id long, ids array<int>, starts array<long>, ends array<long>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(model_path)
        for batch in slices(batches):
            got = [codec.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([g.ids for g in got], pa.list_(pa.int32())),
                    pa.array([g.starts for g in got], pa.list_(pa.int64())),
                    pa.array([g.ends for g in got], pa.list_(pa.int64())),
                    pa.array([g.decoded for g in got], pa.string()),
                ],
                names=["id", "ids", "starts", "ends", "decoded"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digest(docs: DataFrame, *, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same per text, as digests: ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, ``spans_sha256``.

    ``spans_sha256`` hashes the piece ends as little-endian 64-bit integers;
    ``whole`` tells whether the spans run gaplessly over the whole text.
    """
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, whole boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sha = shared_codec(model_path), hashlib.sha256
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                e = codec.encode(text or "")
                size = len((text or "").encode())
                whole = bool(len(e.ends) == 0 and size == 0 or len(e.ends) and e.starts[0] == 0 and e.ends[-1] == size)
                rows.append((len(e.ids), sha(e.id_text.encode()).hexdigest(), sha(e.decoded.encode()).hexdigest(), sha(e.ends.astype("<i8").tobytes()).hexdigest(), whole))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.record_batch(
                [batch.column(0), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:4]), pa.array(columns[4], pa.bool_())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "whole"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)

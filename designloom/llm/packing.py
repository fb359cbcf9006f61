"""Packing by concatenate-and-cut (operator 5).

Pass one encodes every document once and writes ids and totals to the shared
folder, each row with the number of its partition and its start inside it. The
partition totals (one row per partition) become global offsets by a prefix sum;
pass two cuts the concatenated stream into fixed windows, so every window is
full except the last one, and a document that crosses a window border leaves
one boundary record (piece) per window it touches.

Encoding goes by space-separated parts where the tokenizer allows it; only a
part not met before is given to the library.

Defined cases: a null or empty text has only the end id; an empty table has no
pieces; repeated rows are packed as often as they occur; other columns are
ignored. The order of documents is that of the stored partitions.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, claim_memory, cut, drop_table, slices, write_table

WINDOW = 4096
#: Bytes that one Python worker spends on parts of texts with their ids (half as many on words that are no such part); an entry's own bytes, and the longest part kept.
CACHE_BYTES, ENTRY_BYTES, LONG_PART = 64 << 20, 200, 64


class WordEncoder(dict):
    """Ids of whole texts, as little-endian 32-bit bytes, by a cache of space-separated parts.

    The cache holds only for tokenizers that normalise by NFC, white space and
    lower case, and split by a pattern that drops white space: no composition,
    split or merge then crosses a space, so the ids of a text are those of its
    parts in order, and those of a part are those of its words. Others encode
    whole texts. Caches are bounded in bytes, and stop growing when full; later
    parts are worked out anew.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", ())
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", ())]
        self.model = self.tokenizer.model
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.by_part = (
            kinds == ["NFC", "Replace", "Lowercase"]
            and [s["type"] for s in steps] == ["Split", "ByteLevel"]
            and steps[0]["behavior"] == "Removed"
            and steps[0]["invert"]
            and "[^\\s" in steps[0]["pattern"]["Regex"]
            and not steps[1]["use_regex"]
            and not steps[1]["add_prefix_space"]
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in spec["added_tokens"])
        )
        self.split = regex.compile(steps[0]["pattern"]["Regex"]).findall if self.by_part else None
        self.words: dict[str, bytes] = {}
        self.part_room, self.word_room = CACHE_BYTES, CACHE_BYTES // 2

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, part: str) -> bytes:
        # Below U+0100 nothing composes, and lower case is the same everywhere.
        keep = self.part_room > 0 and len(part) <= LONG_PART
        if part.isascii() or max(part) < "\u0100":
            low = part.lower()
            # A part that is a word is kept once.
            found = self.word(low, not keep or low != part) if low.isalpha() else b"".join(map(self.word, self.split(low)))
        else:
            found = self.whole(part)
        if keep:
            self.part_room -= ENTRY_BYTES + len(part) + len(found)
            self[part] = found
        return found

    def forget(self) -> None:
        self.clear()
        self.words.clear()
        self.part_room, self.word_room = CACHE_BYTES, CACHE_BYTES // 2

    def word(self, word: str, keep: bool = True) -> bytes:
        found = self.words.get(word)
        if found is None and (found := self.get(word)) is None:
            if word.isascii() and word.isprintable():
                # The model alone: its alphabet maps these bytes to themselves.
                ids = [t.id for t in self.model.tokenize(word)]
                found = struct.pack(f"<{len(ids)}I", *ids)
            else:
                found = self.whole(word)
            if keep and self.word_room > 0 and len(word) <= LONG_PART:
                self.word_room -= ENTRY_BYTES + len(word) + len(found)
                self.words[word] = found
        return found

    def __call__(self, text: str) -> bytes:
        if not self.by_part or any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder and cache per Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordEncoder(path)


def encode_table(docs: DataFrame, tokenizer_path: str, end_id: int, *, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """Pass one, written: ``id, ids, n, part, start`` (start of the document inside its partition)."""
    schema = "id long, ids binary, n long, part int, start long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, start = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        claim_memory("packing", encode.forget)
        for batch in slices(batches):
            ids = [encode(t or "") + end for t in batch.column(1).to_pylist()]
            n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            at = start + np.cumsum(n) - n
            start += int(n.sum())
            yield pa.record_batch(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(at)],
                names=["id", "ids", "n", "part", "start"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return write_table(rows.mapInArrow(run, schema), "packing")


def pack(
    docs: DataFrame,
    *,
    tokenizer_path: str,
    end_id: int,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces: id, ``start``, ``length``, ``ids`` (bytes), ``doc_tokens``, ``sequence_id``, ``offset``.

    ``start`` counts the document's ids before the piece, ``offset`` those of
    the sequence before it. The encoded texts stay under ``spark.checkpoint.dir``
    as long as the pieces may be read.
    """
    stored, _ = encode_table(docs, tokenizer_path, end_id, id_col=id_col, text_col=text_col)
    return _cut_into_pieces(stored, window, id_col)


def _cut_into_pieces(stored: DataFrame, window: int, id_col: str) -> DataFrame:
    """Pass two."""
    spark = stored.sparkSession
    # One row per stored partition; their prefix sums are the global offsets.
    totals = sorted(tuple(r) for r in stored.groupBy("part").agg(F.sum("n")).collect())
    bases, base = [], 0
    for part, n in totals:
        bases.append((part, base))
        base += n
    # As Arrow: a list would start Python workers of another kind, which stay beside the others.
    offsets = spark.createDataFrame(pa.table({"part": pa.array([b[0] for b in bases], pa.int32()), "base": pa.array([b[1] for b in bases], pa.int64())}))
    if len(bases) <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    rows = stored.join(offsets, "part").select("id", "ids", "n", (F.col("base") + F.col("start")).alias("at"))
    schema = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n = batch.column(2).to_numpy(zero_copy_only=False)
            at = batch.column(3).to_numpy(zero_copy_only=False)
            # A document touches windows first..last; one piece for each.
            first, last = at // window, (at + n - 1) // window
            pieces = last - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[row] + nth
            begin = np.maximum(sequence * window, at[row])
            stop = np.minimum((sequence + 1) * window, (at + n)[row])
            start, length = begin - at[row], stop - begin
            bodies = batch.column(1).to_pylist()
            ids = [bodies[r][4 * s : 4 * (s + k)] for r, s, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            yield pa.record_batch(
                [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(ids, pa.binary()), pa.array(n[row]), pa.array(sequence), pa.array(begin - sequence * window)],
                names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame, *, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """Padded sequences ``sequence_id, ids array<int>, n`` of packed ``pieces``; a group is one window."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("offset").to_numpy(), kind="stable")
        parts = table.column("ids").to_pylist()
        ids = np.frombuffer(b"".join(parts[i] for i in order), dtype="<u4").astype(np.int32)
        padded = np.concatenate([ids, np.full(window - len(ids), pad_id, np.int32)])
        return pa.table({"sequence_id": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([padded], pa.list_(pa.int32())), "n": pa.array([len(ids)], pa.int64())})

    return pieces.groupBy("sequence_id").applyInArrow(run, "sequence_id long, ids array<int>, n long")


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with ``ids_crc32`` in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def packed_digest(docs: DataFrame, **options: object) -> DataFrame:
    """The digest of ``pack``, worked out at once; the encoded texts are deleted after."""
    stored, path = encode_table(docs, str(options["tokenizer_path"]), int(options["end_id"]), id_col=str(options.get("id_col", "doc_id")), text_col=str(options.get("text_col", "text")))
    out = cut(digest(_cut_into_pieces(stored, int(options.get("window", WINDOW)), str(options.get("id_col", "doc_id")))))
    drop_table(docs.sparkSession, path)
    return out


def crc32_of(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())

"""Levels, and names of columns, that are too many for the driver: they stay in tables, in order."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence
from datetime import datetime
from itertools import accumulate, product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def level_text(level: object) -> str:
    """A level as part of a column name: text as it is, anything else as Python writes it."""
    if isinstance(level, str):
        return level
    if isinstance(level, (bytes, bytearray)):
        try:
            return bytes(level).decode()
        except UnicodeDecodeError:
            return repr(bytes(level))
    return repr(level)


def plain(level: object, whole: bool) -> object:
    """A level as ``collect`` gives it; ``whole``: from a column of whole numbers, which are computed as doubles."""
    if isinstance(level, bytearray):
        return bytes(level)
    if isinstance(level, datetime) and level.tzinfo is not None:
        return level.astimezone().replace(tzinfo=None)
    return int(level) if whole and level is not None and not math.isnan(level) else level


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _held(df: DataFrame) -> DataFrame:
    """``df`` as it is now, rows of each partition in order."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


def _numbered(df: DataFrame) -> tuple[DataFrame, int]:
    """Rows of a DataFrame that is held, numbered by partition and place as ``number``; and how many there are."""
    counts = {r[0]: r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()}
    starts = [0, *accumulate(counts.get(i, 0) for i in range(max(counts, default=-1) + 1))]
    first = F.get(F.array(*[F.lit(s).cast("long") for s in starts]), F.spark_partition_id())
    return df.withColumn("number", first + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), starts[-1]


class Levels(Sequence):
    """Levels in order, in a ``table`` of (level, number). As a sequence they come to the driver, when asked for."""

    def __init__(self, table: DataFrame, size: int, *, number: bool, whole: bool, first: Sequence, null: bool) -> None:
        self.table, self.size, self.number, self.whole, self.first, self.null = table, size, number, whole, list(first), null
        self.known: dict[str, int | None] = {}

    @classmethod
    def found(cls, column: Column, df: DataFrame, *, number: bool, whole: bool, is_level: Callable[[object], bool] | None, missing: Column | None) -> Levels:
        """Distinct values of ``column``, save those ``missing`` (of "level") or, for a rule of the user, not ``is_level``."""
        values = df.select(column.alias("level")).distinct()
        if is_level is not None:

            @F.udf("boolean")
            def kept(level: object) -> bool:
                return bool(is_level(plain(level, whole)))

            values = values.where(kept("level"))
        elif missing is not None:
            values = values.where(~missing)
        # As lists are: numbers, then null, then anything else.
        held = _held(values.orderBy(F.col("level").asc_nulls_last() if number else F.col("level").asc_nulls_first()))
        table, size = _numbered(held)
        null = bool(held.where("level IS NULL").limit(1).count())
        return cls(table, size, number=number, whole=whole, first=[plain(r[0], whole) for r in held.head(5)], null=null)

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator:
        return (plain(r[0], self.whole) for r in self.table.select("level").toLocalIterator(prefetchPartitions=True))

    def __getitem__(self, at: int | slice) -> object:
        if isinstance(at, slice):
            start, stop, step = at.indices(len(self))
            if step != 1:
                return list(self)[at]
            if stop <= len(self.first):
                return self.first[at]
            rows = self.table.where(F.col("number").between(start, stop - 1)).collect()
            return [plain(r.level, self.whole) for r in sorted(rows, key=lambda r: r.number)]
        if not -len(self) <= at < len(self):
            raise IndexError(at)
        return self[at % len(self) : at % len(self) + 1][0]

    def __contains__(self, level: object) -> bool:
        return self._place(level) is not None

    def index(self, level: object) -> int:
        at = self._place(level)
        if at is None:
            raise ValueError(f"{level!r} is not a level")
        return at

    def _place(self, level: object) -> int | None:
        if level is None:
            test = F.col("level").isNull()
        elif self.number:
            if not isinstance(level, (bool, int, float)):
                return None
            test = F.col("level") == F.lit(float(level))
        else:
            if isinstance(level, (bool, int, float)):
                return None
            test = F.col("level") == (F.lit(bytearray(level)) if isinstance(level, bytes) else F.lit(level))
        row = self.table.where(test).first()
        return None if row is None else row.number

    def named(self, text: str) -> int | None:
        """The number of the level that column names write as ``text``."""
        self.look_up({text})
        return self.known[text]

    def look_up(self, texts: set[str]) -> None:
        """Find the numbers of several levels by one query, and remember them."""
        texts = texts - self.known.keys()
        if not texts:
            return
        self.known.update(dict.fromkeys(texts))
        if self.number:
            values = [v for t in texts if (v := _number(t)) is not None]
            rows = self.table.where(F.col("level").isin(values) | F.col("level").isNull() if "None" in texts else F.col("level").isin(values)).collect()
        elif self.table.schema["level"].dataType.typeName() == "string":
            test = F.col("level").isin(list(texts))
            rows = self.table.where(test | F.col("level").isNull() if "None" in texts else test).collect()
        else:
            rows = [(r.name, r.number) for r in self.names("", "").where(F.col("name").isin(list(texts))).collect()]
        # Other ways to write a number are no names.
        self.known.update({t: n for v, n in rows if (t := level_text(plain(v, self.whole))) in texts})

    def names(self, before: str, after: str) -> DataFrame:
        """(number, name) of all levels, as column names write them."""
        whole, table = self.whole, self.table.select("number", "level")

        def named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [f"{before}{level_text(plain(v, whole))}{after}" for v in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["number", "name"])

        return table.mapInArrow(named, "number long, name string")

    def __repr__(self) -> str:
        return f"<{len(self)} levels: {', '.join(map(repr, self.first))}, ...>"


class LevelNames(Sequence):
    """Names ``before + level + "]"`` of columns for levels in a table, maybe ``without`` the one of a number."""

    def __init__(self, before: str, levels: Levels, without: int | None = None) -> None:
        self.before, self.levels, self.without = before, levels, without

    def after(self, text: str) -> LevelNames:
        return LevelNames(text + self.before, self.levels, self.without)

    def level(self, at: int) -> int:
        """Number of the level of a column."""
        return at + (self.without is not None and at >= self.without)

    def column(self, number: int | None) -> int | None:
        """Column of the level of a number."""
        return None if number is None or number == self.without else number - (self.without is not None and number > self.without)

    def __len__(self) -> int:
        return len(self.levels) - (self.without is not None)

    def __getitem__(self, at: int | slice) -> str | list[str]:
        if isinstance(at, slice):
            return [self[i] for i in range(*at.indices(len(self)))]
        if not -len(self) <= at < len(self):
            raise IndexError(at)
        return f"{self.before}{level_text(self.levels[self.level(at % len(self))])}]"

    def __iter__(self) -> Iterator[str]:
        return (f"{self.before}{level_text(v)}]" for i, v in enumerate(self.levels) if i != self.without)

    def table(self) -> DataFrame:
        """(k, name) by column."""
        found = self.levels.names(self.before, "]")
        if self.without is None:
            return found.select(F.col("number").alias("k"), "name")
        number = F.col("number")
        return found.where(number != self.without).select((number - (number > self.without).cast("long")).alias("k"), "name")


#: What names of numerical levels have in brackets.
_NUMBERS = re.compile(r"\[(T\.)?(?:-?\d[\d.e+-]*|None|nan|-?inf)\]")


class Names(Sequence):
    """Names of a design's columns: for each part of it the names of its factors' columns, joined by colons, the leftmost varying fastest."""

    def __init__(self, parts: Sequence[Sequence[Sequence[str]]]) -> None:
        self.parts = list(parts)
        self.starts = [0, *accumulate(math.prod(map(len, p)) for p in self.parts)]

    def __len__(self) -> int:
        return self.starts[-1]

    def __iter__(self) -> Iterator[str]:
        return (":".join(reversed(c)) for part in self.parts for c in product(*reversed(part)))

    def __getitem__(self, at: int | slice) -> str | list[str]:
        if isinstance(at, slice):
            wanted = range(*at.indices(len(self)))
            return list(self) if len(wanted) == len(self) and wanted.step == 1 else [self[i] for i in wanted]
        if not -len(self) <= at < len(self):
            raise IndexError(at)
        at %= len(self)
        which = bisect_right(self.starts, at) - 1
        k, out = at - self.starts[which], []
        for own in self.parts[which]:
            k, j = divmod(k, len(own))
            out.append(own[j])
        return ":".join(out)

    def __eq__(self, other: object) -> bool:
        return self is other or isinstance(other, (list, Names)) and len(self) == len(other) and all(a == b for a, b in zip(self, other, strict=True))

    __hash__ = None

    def __contains__(self, name: object) -> bool:
        return isinstance(name, str) and next(self._places(name), None) is not None

    def index(self, name: str) -> int:
        at = next(self._places(name), None)
        if at is None:
            raise ValueError(f"{name!r} is no column")
        return at

    def look_up(self, names: Iterable[str]) -> None:
        """Find the levels of several columns, by a query for each table."""
        asked: dict[int, tuple[Levels, set[str]]] = {}

        def ask(levels: Levels, text: str) -> int:
            asked.setdefault(id(levels), (levels, set()))[1].add(text)
            return len(levels)

        for name in names:
            for _ in self._places(name, ask):
                pass
        for levels, texts in asked.values():
            levels.look_up(texts)

    def _places(self, name: str, ask: Callable[[Levels, str], int | None] = Levels.named) -> Iterator[int]:
        def within(part: Sequence[Sequence[str]], text: str) -> Iterator[int]:
            """Places among the products of ``part`` of the name ``text``."""
            own, rest = part[0], part[1:]
            if isinstance(own, LevelNames):
                if not text.startswith(own.before):
                    return
                tail = text[len(own.before) :]
                cuts = [m.start() for m in re.finditer(r"\]:", tail)] if rest else [len(tail) - 1] * tail.endswith("]")
                heads = ((own.column(ask(own.levels, tail[:cut])), tail[cut + 2 :]) for cut in cuts)
            else:
                heads = ((k, text[len(n) + 1 :]) for k, n in enumerate(own) if (text.startswith(n + ":") if rest else text == n))
            for k, left in heads:
                if k is not None:
                    yield from (k + len(own) * more for more in within(rest, left)) if rest else (k,)

        for part, start in zip(self.parts, self.starts, strict=False):
            yield from (start + at for at in within(part, name))

    def table(self, spark: SparkSession) -> DataFrame:
        """(i, column_name) of all columns."""
        plain_rows, frames = [], []
        for part, start in zip(self.parts, self.starts, strict=False):
            if not any(isinstance(own, LevelNames) for own in part):
                plain_rows += enumerate(Names([part]), start)
                continue
            whole, width = None, 1
            for own in part:
                one = own.table() if isinstance(own, LevelNames) else spark.createDataFrame(list(enumerate(own)), "k long, name string")
                if whole is None:
                    whole = one
                else:
                    whole = whole.crossJoin(one.toDF("more", "next")).select((F.col("k") + F.lit(width).cast("long") * F.col("more")).alias("k"), F.concat_ws(":", "name", "next").alias("name"))
                width *= len(own)
            frames.append(whole.select((F.col("k") + start).alias("i"), F.col("name").alias("column_name")))
        if plain_rows or not frames:
            frames.append(spark.createDataFrame(plain_rows, "i long, column_name string"))
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def repeated(self) -> str | None:
        """A name that two columns have."""
        tables = [own for part in self.parts for own in part if isinstance(own, LevelNames)]
        if all(own.levels.number for own in tables) and self._apart():
            return None
        found = self.table(tables[0].levels.table.sparkSession)
        if found.agg(F.count_distinct(F.xxhash64("column_name"))).first()[0] == len(self):
            return None
        row = found.groupBy("column_name").count().where("count > 1").first()
        return row and row.column_name

    def _apart(self) -> bool:
        """Whether names differ already without the numbers in brackets, but for the numbers of a factor. A name is what is left and those numbers, so then all differ."""
        bare, listed = [], []
        for part in self.parts:
            if any(isinstance(own, LevelNames) for own in part):
                kinds = [[f"{own.before}0]"] if isinstance(own, LevelNames) else own for own in part]
                bare += Names([[list(dict.fromkeys(_NUMBERS.sub(r"[\1]", n) for n in own)) for own in kinds]])
            else:
                listed += Names([part])
        return len(set(bare)) == len(bare) and len(set(listed)) == len(listed) and not {_NUMBERS.sub(r"[\1]", n) for n in listed} & set(bare)

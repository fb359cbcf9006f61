"""Exact deduplication (operator 6).

Rows are grouped by a 128-bit hash of their normalised text. The bytes inside
each group are compared by a pair of commutative aggregates: the smallest and
the largest text of a group are equal exactly when all its texts are, and both
are combined before the shuffle, so a group that holds a third of the table
reaches the reducer as one row per map task. Groups that do hold different
bytes (hash collisions) are regrouped by the texts themselves.

Defined cases: a null text counts as empty; empty texts form one group; a null
id loses every tie; rows that repeat the id of the kept row are kept with it; an
empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted

#: Fixed value: the characters deleted before comparing, U+0020 and U+0009 to U+000D.
IGNORED = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), IGNORED, "")


def exact_groups(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    hash_fn: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``hash_fn`` maps the normalised text to its grouping hash (128-bit MD5).
    """
    text = normalised(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"),
        hash_fn(text).alias("h"),
        F.sha2(text, 256).alias("text_sha256"),
        text.alias("body"),
    )
    # -1 - id orders ids downwards without overflow; nulls sort lowest in max().
    best = F.max(F.struct("n", (F.lit(-1) - F.col("id")).alias("down")))
    found = cut(
        rows.groupBy("h")
        .agg(F.count("*").alias("group_size"), best.alias("best"), F.min("body").alias("lo"), F.max("body").alias("hi"))
        .select("h", "group_size", (F.lit(-1) - F.col("best.down")).alias("keep_id"), (F.col("lo") != F.col("hi")).alias("mixed"))
    )
    # Most texts stand alone; only groups of more are looked up.
    groups = found.where("group_size > 1")
    narrow = rows.select("id", "h", "text_sha256")
    mixed = groups.where("mixed").select("h")
    clashes = mixed.limit(1).count() > 0
    out = join_counted(narrow, groups.where("NOT mixed").select("h", "group_size", "keep_id"), "h", "left")
    if clashes:
        out = join_counted(out, mixed, "h", "left_anti")
    grouped = F.col("group_size").isNotNull()
    columns = ["id", F.when(grouped, F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "text_sha256"]
    out = out.select(*columns)
    if clashes:
        clash = join_counted(rows, mixed, "h", "left_semi")
        again = cut(clash.groupBy("body").agg(F.count("*").alias("group_size"), best.alias("best")))
        again = again.select("body", "group_size", (F.lit(-1) - F.col("best.down")).alias("keep_id"))
        out = out.union(clash.join(again, "body").select("id", "keep_id", "group_size", "text_sha256"))
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )

"""A training-data pipeline over ``documents``, in five stages.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet and reread as the next one's ``docs``. All but the last return the
columns of ``docs``. Every stage works on all that its predecessor kept.

* toxicity: documents whose grade is likelier above 0 than not go;
* exact dedup: one document of each group of equal texts stays;
* near dedup: one document (the smallest id) of each component of documents
  that share 80% or more of their five-word shingles stays;
* secrets: secrets are replaced by a mark in the text, and ``n_chars`` follows;
* packing: pieces of sequences of 4096 tokens.

Defined cases, for every stage: a null text counts as empty, is never toxic and
never a near copy, stays null when secrets are masked, and packs as its end id;
null texts and empty ones are equal texts, of which one row stays; rows without
an id are never dropped as copies; rows that repeat id and text stay once, rows
that repeat an id with other texts stay; an empty table gives an empty one (or no
pieces); ties of length go to the smallest id; other columns, whatever their
names, pass through. Tables between stages are deleted once they have been read.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from designloom.llm import exact_dedup, ngram_join, packing, secrets_crf, toxicity
from designloom.llm.common import drop_table, join_counted, write_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on the labels of the table; without labels of both classes all documents stay."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.kept(docs, model)


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays, then the smallest id; repeated rows of it once. Rows without an id stay."""
    digest, place = _unused(docs, "text_sha256"), _unused(docs, "place")
    key = ["doc_id", digest]
    groups = exact_dedup.exact_groups(docs).withColumnRenamed("text_sha256", digest)
    hashed = docs.withColumn(digest, F.sha2(exact_dedup.normalised(F.col("text")), 256))
    # An id may stand on several texts: a row is known by both.
    left = join_counted(hashed, groups.where("NOT kept AND doc_id IS NOT NULL").select(*key).distinct(), key, "left_anti")
    twice = groups.where("kept AND doc_id IS NOT NULL").groupBy(*key).count().where("count > 1").select(*key)
    if not twice.limit(1).count():
        return left.select(*docs.columns)
    first = Window.partitionBy(*key).orderBy(F.char_length("text").desc(), "text")
    again = left.join(twice, key, "left_semi").withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
    return left.join(twice, key, "left_anti").select(*docs.columns).unionByName(again.select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the smallest id stays; rows of one id are taken for one document. Rows without an id or words stay."""
    found = ngram_join.near_components(docs, k=5, num=80, den=100)
    return join_counted(docs, found.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on the table itself; without a labelled secret the patterns alone mask. Null texts keep their ``n_chars``."""
    masked = secrets_crf.redacted(docs, secrets_crf.train(docs))
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row is packed, repeated ones too; the order of documents is that of the stored partitions."""
    return packing.packed_digest(docs, tokenizer_path=public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: No stage but the exact one can be told in SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), ""
    for name, stage in STAGES[:-1]:
        docs, path = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if read:
            drop_table(spark, read)
        read = path
    # The last stage gives what it has already worked out.
    out = STAGES[-1][1](spark, docs, sf_dir)
    drop_table(spark, read)
    return out

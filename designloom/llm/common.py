"""Shared plumbing of the training-data operators.

* scratch tables live under the folder named by ``spark.checkpoint.dir``;
* Python stages cut the Arrow batches they get into slices of few rows, so one
  task never holds many long texts at once, whatever the session is set to;
* what a Python worker remembers is bounded in bytes, and given back to the
  system when another operator starts in that worker;
* connected components run as rounds in which every node and its neighbours move
  to the smallest of them; their state is edges only and never leaves the
  executors.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one slice of a batch, in stages that read texts.
TEXT_ROWS = 256
#: Most rows of a side that is broadcast after counting it.
BROADCAST_ROWS = 1_000_000
#: Edges that one union-find of a task holds at once.
FOREST_EDGES = 200_000


_claimed: tuple[str, Callable[[], None]] | None = None


def claim_memory(owner: str, clear: Callable[[], None]) -> None:
    """Python workers outlive stages: whoever starts to remember things lets the one before forget."""
    global _claimed
    if _claimed is not None and _claimed[0] != owner:
        _claimed[1]()
        release_memory()
    _claimed = owner, clear


def release_memory() -> None:
    """Free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return


def slices(batches: Iterator[pa.RecordBatch], rows: int = TEXT_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_RUNS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """Longest runs of letters (Unicode's; digits and other numerals are none)."""
    runs = _RUNS.findall(text)
    if all(map(str.isalpha, runs)):
        return runs
    return [w for run in runs for w in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a fresh local one only where one machine runs all and none is set (tests)."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="designloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str, *, compression: str = "zstd") -> tuple[DataFrame, str]:
    """Materialise ``df`` as a Parquet table in the shared folder; returns it reread, and its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint: recovery no longer needs the lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_counted(left: DataFrame, right: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """Join a narrow ``right``: broadcast when its counted rows are few, else by shuffle."""
    if right.count() <= BROADCAST_ROWS:
        right = F.broadcast(right)
    return left.join(right, on, how)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges ``x, m`` (m < x) that join what the given ones join; each piece of the input becomes stars."""
    for table in slices(batches, FOREST_EDGES):
        ends = np.stack([table.column(0).to_numpy(), table.column(1).to_numpy()])
        nodes, place = np.unique(ends, return_inverse=True)
        x, m = place.reshape(ends.shape)
        root = np.arange(len(nodes))
        # Roots hang under the smallest root that an edge ties them to, until no edge ties two.
        while len(x):
            np.minimum.at(root, np.maximum(x, m), np.minimum(x, m))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
            x, m = root[x], root[m]
            open_ = x != m
            x, m = x[open_], m[open_]
        below = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.record_batch([pa.array(nodes[below]), pa.array(nodes[root[below]]), pa.array(np.zeros(len(below), bool))], names=["x", "m", "open"])


def connected_components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id per node of undirected ``edges`` (columns ``a`` and ``b``).

    Returns ``node, component`` for nodes with an edge to another node. Loops,
    repeated and reversed edges are harmless. Tasks first replace their own edges
    by stars. Then, in each round, every node learns the smallest of itself and
    its neighbours, and passes it to them; rounds end when all edges are stars
    around their smallest nodes. Hub nodes only cost partial aggregation and a
    joinable (splittable) side; every round is checkpointed.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("x"), F.least("a", "b").cast("long").alias("m"))
    now = cut(pairs.mapInArrow(_forest, "x long, m long, open boolean"))
    for _ in range(max_rounds):
        both = now.select("x", "m").union(now.select(F.col("m").alias("x"), F.col("x").alias("m")))
        # Stored, so that the join deals both sides anew and a hub's rows can be split.
        low = cut(both.groupBy("x").agg(F.least("x", F.min("m")).alias("low")))
        met = both.join(low, "x")
        # A star's rows see either end of their edge as the smallest.
        open_ = (F.col("low") != F.col("x")) & (F.col("low") != F.col("m"))
        passed = met.select(F.col("m").alias("x"), F.col("low").alias("m"), open_.alias("open"))
        passed = passed.union(low.select("x", F.col("low").alias("m"), F.lit(False).alias("open")))
        now = cut(passed.where("x > m").groupBy("x", "m").agg(F.max("open").alias("open")))
        if not now.agg(F.max("open")).first()[0]:
            break
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("x").alias("node"), F.col("m").alias("component")).union(now.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())

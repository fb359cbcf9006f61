"""Designs on streams: fitted designs are a filter and projections, so they apply to streams as they are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from designloom.operators.missing import NAAction
from designloom.plans.design import DesignInfo, build_design_matrices


def transform_stream(designs: Sequence[DesignInfo], stream: DataFrame, NA_action: str | NAAction = "drop", *, keep: Sequence[str] = (), prefixes: Sequence[str] | None = None) -> DataFrame:  # noqa: N803
    """The designs' columns of a streaming DataFrame, row by row, without state."""
    if not stream.isStreaming:
        raise ValueError("not a streaming DataFrame")
    return build_design_matrices(designs, stream, NA_action, keep=keep, prefixes=prefixes)


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what a transformed stream has to Parquet, each row once, and stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

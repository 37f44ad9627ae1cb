"""Neighbours in document order without one task per document.

A document may hold a third of all rows, so a window over the whole document is cut into chunks of pages: the
inner window runs per (document, chunk), and what crosses a chunk's edge comes from a table of one row per chunk.
Rows without a page stand before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGES_PER_CHUNK = 64


def _chunked(df: DataFrame) -> DataFrame:
    return df.withColumn("_chunk", F.coalesce(F.floor(F.col("page_ord") / PAGES_PER_CHUNK), F.lit(-(1 << 40))))


def carry_forward(df: DataFrame, value: Column, out: str, order: list[str]) -> DataFrame:
    """Last non-null value at or before each row of its document, in the given order."""
    b = _chunked(df).withColumn("_v", value)
    w = Window.partitionBy("doc_id", "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = b.withColumn("_in", F.last("_v", ignorenulls=True).over(w))
    per = b.groupBy("doc_id", "_chunk").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_last"))
    d = Window.partitionBy("doc_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("doc_id", "_chunk", F.last("_last", ignorenulls=True).over(d).alias("_before"))
    return inner.join(before, ["doc_id", "_chunk"]).withColumn(out, F.coalesce("_in", "_before")).drop("_chunk", "_v", "_in", "_before")


def previous(df: DataFrame, value: Column, out: str, order: list[str]) -> DataFrame:
    """Value of the row before, in the document's order; null for the first."""
    b = _chunked(df).withColumn("_v", F.struct(value.alias("v")))
    w = Window.partitionBy("doc_id", "_chunk").orderBy(*order)
    inner = b.withColumn("_in", F.lag("_v").over(w))
    per = b.groupBy("doc_id", "_chunk").agg(F.max_by("_v", F.struct(*order)).alias("_last"))
    d = Window.partitionBy("doc_id").orderBy("_chunk")
    before = per.select("doc_id", "_chunk", F.lag("_last").over(d).alias("_before"))
    return (
        inner.join(before, ["doc_id", "_chunk"])
        .withColumn(out, F.coalesce("_in", "_before")["v"])
        .drop("_chunk", "_v", "_in", "_before")
    )

"""Body blocks as TESTDATA.md defines them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def body_blocks(blocks: DataFrame) -> DataFrame:
    """Digital blocks whose path ends in P or LBody and whose text is not empty; filtered in the scan's stage."""
    return blocks.where(
        (F.col("layer") == "digital") & F.col("path").rlike(r"(^|/)(P|LBody)(\[[0-9]+\])?$") & (F.col("text") != "")
    )

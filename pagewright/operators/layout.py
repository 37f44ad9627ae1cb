"""Page geometry, header and footer filters, font modes, page breaks, titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators.ordered import carry_forward

HEADER_RATIO, FOOTER_RATIO = 0.05, 0.05


BLOCK_COLUMNS = ("block_id", "doc_id", "page_id", "page_ord", "ord", "path", "text", "font_size", "x0", "y0", "x1", "y1")
PAGE_COLUMNS = ("doc_id", "page_id", "page_ord", "width", "height", "main_font_size", "title")


def distinct_blocks(blocks: DataFrame) -> DataFrame:
    """Exact duplicate rows share block_id, so one exchange on it removes them; blocks without text go.

    Only the engine's columns are kept, so other columns of the input clash with nothing. Blocks without a position
    count as neither margin nor body.
    """
    return blocks.select(*BLOCK_COLUMNS).where("text is not null").dropDuplicates(["block_id"])


def distinct_pages(pages: DataFrame) -> DataFrame:
    return pages.select(*PAGE_COLUMNS).dropDuplicates(["doc_id", "page_id"])


def page_origins(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_id, from_bottom): whether y runs upwards, as the page's first block stands above its middle."""
    first = blocks.groupBy("doc_id", "page_id").agg(F.min_by("y0", "ord").alias("first_y"))
    return pages.join(first, ["doc_id", "page_id"]).select(
        "doc_id", "page_id", (F.col("first_y") > F.col("height") / 2).alias("from_bottom")
    )


def oriented(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks with their page's values and y counted from the top (top, bottom).

    Repeated rows share their page too, so one exchange by page serves their removal, the page's first block and the join.
    """
    b = blocks.select(*BLOCK_COLUMNS).where("text is not null").repartition("doc_id", "page_id").dropDuplicates(["doc_id", "page_id", "block_id"])
    p = distinct_pages(pages)
    first = b.groupBy("doc_id", "page_id").agg(F.min_by("y0", "ord").alias("first_y"))
    info = p.join(first, ["doc_id", "page_id"]).select(
        "doc_id", "page_id", "height", "width", "main_font_size", "title",
        (F.col("first_y") > F.col("height") / 2).alias("from_bottom"),
    )
    return b.join(info, ["doc_id", "page_id"]).select(
        "*",
        F.when(F.col("from_bottom"), F.col("height") - F.col("y1")).otherwise(F.col("y0")).alias("top"),
        F.when(F.col("from_bottom"), F.col("height") - F.col("y0")).otherwise(F.col("y1")).alias("bottom"),
    )


def in_margin(header: float = HEADER_RATIO, footer: float = FOOTER_RATIO, top="top", bottom="bottom"):
    return (F.col(top) <= F.col("height") * header) | (F.col(bottom) >= F.col("height") * (1 - footer))


def is_small():
    return F.col("font_size") < F.col("main_font_size")


def flagged(o: DataFrame) -> DataFrame:
    return o.select(
        "block_id", in_margin().alias("in_margin"), is_small().alias("is_small"),
        F.col("path").rlike(T.TABLE_PATH).alias("in_table"),
    )


def body(o: DataFrame) -> DataFrame:
    """Blocks outside the margins and not of small print."""
    return o.where(~in_margin() & ~is_small())


def valid(o: DataFrame) -> DataFrame:
    return body(o).where(~F.col("path").rlike(T.TABLE_PATH))


def main_font_sizes(b: DataFrame) -> DataFrame:
    """Per page the whole font size with most characters; of equals the one seen first."""
    sizes = b.groupBy("doc_id", "page_id", F.col("font_size").cast("int").alias("size")).agg(
        F.sum(F.length("text")).alias("chars"), F.min("ord").alias("first_ord")
    )
    return sizes.groupBy("doc_id", "page_id").agg(
        F.max_by("size", F.struct("chars", -F.col("first_ord"))).alias("main_font_size")
    )


def document_font_modes(b: DataFrame) -> DataFrame:
    """Per document the font size with most characters; of equals the smallest."""
    sizes = b.groupBy("doc_id", "font_size").agg(F.sum(F.length("text")).alias("chars"))
    return sizes.groupBy("doc_id").agg(F.max_by("font_size", F.struct("chars", -F.col("font_size"))).alias("font_mode"))


def page_breaks(o: DataFrame, pages: DataFrame) -> DataFrame:
    """Path of each page's last body block; pages without one keep that of the page before, the first has ''."""
    ends = (
        body(o)
        .where(~F.col("path").rlike("Figure|Table|Footnote"))
        .groupBy("doc_id", "page_id")
        .agg(F.max_by("path", "ord").alias("last_path"))
    )
    p = distinct_pages(pages).select("doc_id", "page_id", "page_ord").join(ends, ["doc_id", "page_id"], "left")
    filled = carry_forward(p, F.col("last_path"), "page_break", ["page_ord"])
    return filled.select("doc_id", "page_id", F.coalesce("page_break", F.lit("")).alias("page_break"))


def document_titles(b: DataFrame) -> DataFrame:
    """First non-empty text under a title path, per document."""
    t = b.where(F.col("path").rlike(T.TITLE_PATH) & (F.col("text") != ""))
    return t.groupBy("doc_id").agg(F.min_by("text", "ord").alias("title"))


def without_titles(b: DataFrame) -> DataFrame:
    """Blocks but for title blocks that repeat the document's title."""
    t = document_titles(b).withColumnRenamed("title", "_title")
    drop = F.col("path").rlike(T.TITLE_PATH) & F.coalesce(F.col("text") == F.col("_title"), F.lit(False))
    return b.join(t, "doc_id", "left").where(~drop).drop("_title")


def heading_blocks(o: DataFrame) -> DataFrame:
    return o.where(F.col("path").rlike(T.CAPTION_PATH))

"""Entry points: analyse a corpus, and the scalar label functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.kernels import has_label, labels_of
from pagewright.operators.knowledge import knowledge
from pagewright.plans.session import materialise
from pagewright.sources.bundles import bundle_tables, read_bundles
from pagewright.sources.files import of_contents, read_images, read_xlsx

__all__ = ["analyze", "analyze_bundles", "analyze_folder", "existLabel", "getLabels"]


def analyze(
    blocks: DataFrame, pages: DataFrame, contents: DataFrame, base_url: str = "http://contents.example", deep: bool = False,
    cells: DataFrame | None = None, images: DataFrame | None = None, files: DataFrame | None = None, page_break_stop: bool = False,
) -> DataFrame:
    """Knowledge records of all documents of the three tables; cells and images (content_id, one_colour) let more contents
    be checked, files (doc_id, filename) names the documents."""
    return knowledge(blocks, pages, contents, base_url, deep, cells, images, files=files, page_break_stop=page_break_stop)


def analyze_bundles(
    bundles: DataFrame, base_url: str = "http://contents.example", deep: bool = False,
    cells: DataFrame | None = None, images: DataFrame | None = None,
) -> DataFrame:
    """Knowledge records of extracted bundles (bundle_id, doc_id, payload); every text with a label is a caption."""
    named = bundles.select(F.col("bundle_id").alias("doc_id"), "filename") if "filename" in bundles.columns else None
    return knowledge(*bundle_tables(bundles), base_url, deep, cells, images, every_caption=True, files=named)


def analyze_folder(spark: SparkSession, path: str, base_url: str = "http://contents.example", deep: bool = False) -> DataFrame:
    """Knowledge records of a folder of extracted bundles: each a structuredData.json with its figures and spreadsheets
    beside it. Images of one colour and tables that are empty or of one row are left out."""
    bundles = materialise(read_bundles(spark, path))
    blocks, pages, contents = bundle_tables(bundles)
    cells = of_contents(read_xlsx(spark, path, whole_path=True).withColumnRenamed("content_id", "path"), contents, bundles)
    images = of_contents(read_images(spark, path).select("path", "one_colour"), contents, bundles)
    files = bundles.select(F.col("bundle_id").alias("doc_id"), "filename")
    return knowledge(blocks, pages, contents, base_url, deep, cells, images, every_caption=True, files=files)


def getLabels(text: str | None, isCaption: bool = False) -> list[str]:  # noqa: N802, N803
    return labels_of(text, isCaption)


def existLabel(text: str | None, isCaption: bool = False) -> bool:  # noqa: N802, N803
    return has_label(text, isCaption)

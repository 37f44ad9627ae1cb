"""Extracted bundles (structuredData.json) as pages, blocks and contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators.layout import main_font_sizes
from pagewright.operators.nested import nested_nodes

FIGURE_PATH, TABLE_PATH = r"^//Document/(?:.*)?Figure", r"^//Document/(?:.*)?Table"


def read_bundles(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Bundles of a folder, one file each: (bundle_id, doc_id, filename, layer, payload); ids are hashes of the file's path."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    return files.select(
        F.xxhash64(F.input_file_name()).alias("bundle_id"), F.xxhash64(F.input_file_name()).alias("doc_id"),
        F.input_file_name().alias("filename"), F.lit("digital").alias("layer"), F.col("value").alias("payload"),
    )


def _ordered(nodes: DataFrame) -> DataFrame:
    """Elements with ord, their place in the walk of their bundle; a bundle is one payload, so the window is bounded."""
    steps = F.transform(F.split("node_pos", r"\."), lambda x: x.cast("int"))
    w = Window.partitionBy("bundle_id").orderBy(steps)
    return nodes.where("kind = 'element'").withColumn("ord", F.row_number().over(w))


def bundle_tables(bundles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, pages, contents) in the engine's schema, doc_id being the bundle's.

    Title blocks that repeat the document's title are dropped, after they counted for their page's origin and font; y is
    counted from the top, and elements without a page or without four Bounds give no block or content; pages that the
    payload does not describe have the size of what is on them. Only pages with a text exist, in the order in which
    they first appear.
    """
    nodes = nested_nodes(bundles)
    e = _ordered(nodes).drop("width", "height").withColumn("doc_id", F.col("bundle_id"))
    sizes = nodes.where("kind = 'page'").groupBy("bundle_id", "page_id").agg(F.max("width").alias("w"), F.max("height").alias("h"))
    title = e.where(F.col("path").rlike(T.TITLE_PATH) & (F.col("text") != "")).groupBy("bundle_id").agg(F.min_by("text", "ord").alias("title"))
    placed = e.where("page_id >= 1 and x0 is not null")
    texts = placed.where("text is not null").join(title, "bundle_id", "left")
    page = texts.groupBy("bundle_id", "page_id", "title").agg(
        F.max("x1").alias("mx"), F.max("y1").alias("my"), F.min_by("y0", "ord").alias("fy"), F.min("ord").alias("first")
    )
    page = page.join(sizes, ["bundle_id", "page_id"], "left").withColumns({
        "width": F.coalesce("w", "mx"), "height": F.coalesce("h", "my"),
        "page_ord": F.row_number().over(Window.partitionBy("bundle_id").orderBy("first")),
    })
    fonts = main_font_sizes(texts.select("doc_id", "page_id", F.coalesce("text_size", F.lit(0.0)).alias("font_size"), "text", "ord"))
    pages = page.select(
        F.col("bundle_id").alias("doc_id"), F.col("page_id").cast("int").alias("page_id"), "page_ord", "width", "height", "title", "fy"
    ).join(fonts.withColumn("page_id", F.col("page_id").cast("int")), ["doc_id", "page_id"])
    flip = pages.select("doc_id", "page_id", "page_ord", "height", (F.col("fy") > F.col("height") / 2).alias("up"))
    top = F.when(F.col("up"), F.col("height") - F.col("y1")).otherwise(F.col("y0"))
    bottom = F.when(F.col("up"), F.col("height") - F.col("y0")).otherwise(F.col("y1"))
    turned = lambda d: d.withColumn("page_id", F.col("page_id").cast("int")).join(flip, ["doc_id", "page_id"])
    said = texts.where(~(F.col("path").rlike(T.TITLE_PATH) & F.coalesce(F.col("text") == F.col("title"), F.lit(False))))
    blocks = turned(said).select(
        F.xxhash64("bundle_id", "node_pos").alias("block_id"), "doc_id", "page_id", "page_ord", "ord", "path", "text",
        F.coalesce("text_size", F.lit(0.0)).alias("font_size"), "x0", top.alias("y0"), "x1", bottom.alias("y1"),
    )
    files = nodes.where("kind = 'file'").select("bundle_id", F.col("parent_pos").alias("node_pos"), F.col("node_pos").alias("file_pos"), F.col("text").alias("file"))
    kind = F.when(F.col("path").rlike(FIGURE_PATH), "IMAGE").when(F.col("path").rlike(TABLE_PATH) & F.col("file").endswith("xlsx"), "TABLE")
    owned = turned(placed.where("text is null").join(files, ["bundle_id", "node_pos"]))
    contents = owned.withColumn("kind", kind).where("kind is not null").select(
        "doc_id", "page_id", "ord", F.sha2(F.concat_ws("|", "bundle_id", "file_pos"), 256).alias("content_id"), "kind",
        F.lit(None).cast("string").alias("label"), F.col("file").alias("path"), "x0", top.alias("y0"), "x1", bottom.alias("y1"),
        F.array().cast("array<string>").alias("meta"),
    )
    return blocks, pages.drop("fy"), contents


def archive_bundles(bundles: DataFrame, folder: str) -> None:
    """Keep each document's last delivered payload as ``contents/documents/<doc_id>-structuredData.json`` under a shared folder.

    Files have fixed names and contents, so a task that runs again writes the same ones. Null payloads have no file.
    """
    from collections.abc import Iterator

    import pyarrow as pa
    from pyarrow import fs

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        target = f"{root.rstrip('/')}/contents/documents"
        system.create_dir(target, recursive=True)
        for b in batches:
            for doc, payload in zip(*(c.to_pylist() for c in b.columns)):
                with system.open_output_stream(f"{target}/{doc}-structuredData.json") as out:
                    out.write(payload.encode("utf-8", "surrogatepass"))
            yield b.select(["doc_id"])

    when = F.col("received_at") if "received_at" in bundles.columns else F.lit(0)
    last = F.max_by("payload", F.struct(when.alias("at"), "bundle_id"))
    kept = bundles.where("payload is not null and doc_id is not null").groupBy("doc_id").agg(last.alias("payload"))
    kept.mapInArrow(save, "doc_id long").write.format("noop").mode("overwrite").save()

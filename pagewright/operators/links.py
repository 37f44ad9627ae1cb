"""Links between sentences and contents, and contents and pages that no sentence reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators.contents import normal_label


def sentence_labels(sentences: DataFrame) -> DataFrame:
    """(doc_id, page_id, block_id, sent_no, label): labels that each sentence mentions."""
    return sentences.where(T.exists_label(F.col("sentence"))).select(
        "doc_id", "page_id", "block_id", "sent_no", F.explode(T.labels(F.col("sentence"))).alias("label")
    )


def labelled(contents: DataFrame) -> DataFrame:
    return contents.withColumn("label", F.coalesce(normal_label(F.col("label")), F.lit("")))


def label_links(sentences: DataFrame, contents: DataFrame) -> DataFrame:
    """(block_id, sent_no, content_id, kind, label): contents a sentence mentions, each path once per sentence."""
    c = labelled(contents).where("label <> ''").select("doc_id", "label", "content_id", "kind", F.col("path").alias("url"), "ord")
    j = sentence_labels(sentences).join(c, ["doc_id", "label"])
    w = Window.partitionBy("block_id", "sent_no", "url").orderBy("ord", "content_id")
    return j.withColumn("n", F.row_number().over(w)).where("n = 1").select("block_id", "sent_no", "content_id", "kind", "label")


def unreferenced(sentences: DataFrame, contents: DataFrame) -> DataFrame:
    """(content_id, doc_id, page_id, label): contents without label, or whose label no sentence mentions."""
    hit = sentence_labels(sentences).select("doc_id", "label").dropDuplicates()
    return labelled(contents).join(hit, ["doc_id", "label"], "left_anti").select("content_id", "doc_id", "page_id", "label", "kind", F.col("path").alias("url"), "ord")


def unreferenced_pages(sentences: DataFrame, contents: DataFrame) -> DataFrame:
    """(doc_id, page_id, sentence, n_contents): one stand-in sentence per page with contents nobody mentions."""
    u = unreferenced(sentences, contents)
    w = Window.partitionBy("doc_id", "url").orderBy("page_id", "ord", "content_id")
    once = u.withColumn("n", F.row_number().over(w)).where("n = 1")
    return once.groupBy("doc_id", "page_id").agg(F.count(F.lit(1)).alias("n_contents")).select(
        "doc_id", "page_id",
        F.concat_ws("_", F.lit("NO_REFERENCE"), F.col("doc_id").cast("string"), F.col("page_id").cast("string")).alias("sentence"),
        "n_contents",
    )


def speaking_pages(sentences: DataFrame) -> DataFrame:
    return sentences.select("doc_id", "page_id").dropDuplicates()


def silent_pages(sentences: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_id) of pages without a sentence."""
    return pages.select("doc_id", "page_id").dropDuplicates().join(speaking_pages(sentences), ["doc_id", "page_id"], "left_anti")

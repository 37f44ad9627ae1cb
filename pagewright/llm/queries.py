"""Queries of the training-data operators.

Exact duplicate rows of a table give equal results, so duplicates are removed from the narrow results instead
of from the wide inputs: the exchange then carries keys and positions, not texts.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.llm import bpe, languages, normalise, ocr, packing, pieces, sentences, subjects
from pagewright.llm.body import body_blocks
from pagewright.plans.session import table


def p2_found(spark, d):
    return sentences.split_sentences(body_blocks(table(spark, d, "blocks"))).dropDuplicates()


def p3_found(spark, d):
    blocks, limits = body_blocks(table(spark, d, "blocks")), table(spark, d, "size_limits")
    return pieces.split_oversized(blocks, limits).where("piece_no = 0").select("block_id", "cut_at").dropDuplicates()


def p3_pieces(spark, d):
    blocks, limits = body_blocks(table(spark, d, "blocks")), table(spark, d, "size_limits")
    return pieces.split_oversized(blocks, limits).dropDuplicates()


def p4_found(spark, d):
    segments = languages.language_segments(body_blocks(table(spark, d, "blocks")))
    return languages.wrong_labels(segments).dropDuplicates()


def p4_segments(spark, d):
    return languages.language_segments(body_blocks(table(spark, d, "blocks"))).dropDuplicates()


def p5_found(spark, d):
    return normalise.look_alikes(normalise.text_refs(table(spark, d, "blocks"), table(spark, d, "bundles"), "digital"))


def p5_classes(spark, d):
    return normalise.look_classes(normalise.text_refs(table(spark, d, "blocks"), table(spark, d, "bundles"), "digital"))


def p5_normalised(spark, d):
    refs = normalise.text_refs(table(spark, d, "blocks"), table(spark, d, "bundles"), "digital")
    return normalise.normalised_texts(refs.dropDuplicates())


def p6_found(spark, d):
    return ocr.Repairs(table(spark, d, "blocks"), table(spark, d, "bundles")).found()


def p6_paragraphs(spark, d):
    return ocr.Repairs(table(spark, d, "blocks"), table(spark, d, "bundles")).paragraphs()


def p7_ids(spark, d):
    return bpe.encode_documents(table(spark, d, "documents"))


def p7_offsets(spark, d):
    return bpe.encode_documents(table(spark, d, "documents"), what="offsets")


def p8_containers(spark, d):
    return packing.packed(table(spark, d, "documents"), table(spark, d, "containers"))


def p8_filling(spark, d):
    return packing.filling(p8_containers(spark, d), table(spark, d, "containers"))


def p9_found(spark, d):
    return subjects.subjects_of(table(spark, d, "documents"), table(spark, d, "subject_examples")).dropDuplicates()


def p9_composition(spark, d):
    """(subject, n_posts, share): the corpus by subject; share is of all posts that have one, and a post with several counts for each."""
    per = p9_found(spark, d).groupBy("doc_id").agg(F.collect_list("subject").alias("s"))
    each = per.select(F.explode(F.concat("s", F.array(F.lit(None).cast("string")))).alias("subject"))  # null once per post
    n = each.groupBy("subject").agg(F.count(F.lit(1)).alias("n_posts"))
    posts = F.max(F.when(F.col("subject").isNull(), F.col("n_posts"))).over(Window.partitionBy(F.lit(0)))
    return n.withColumn("share", F.col("n_posts") / posts).where("subject is not null")


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_pieces, p4_found, p4_segments, p5_found, p5_classes, p5_normalised, p6_found, p6_paragraphs, p7_ids, p7_offsets, p8_containers, p8_filling, p9_found, p9_composition)}

SQL: dict[str, str] = {}

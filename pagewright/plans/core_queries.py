"""Queries of the document-analysis operators over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.api import analyze, analyze_bundles
from pagewright.operators import classify, contents, layout, links, paragraphs, references as refs, structure
from pagewright.sources.bundles import bundle_tables
from pagewright.sources.files import tables_as_tsv
from pagewright.plans.session import materialise, table

BASE_URL = "http://contents.example"


def oriented(spark, d):
    return layout.oriented(table(spark, d, "blocks"), table(spark, d, "pages"))


def _blocks(spark, d):
    return layout.distinct_blocks(table(spark, d, "blocks"))


def _pages(spark, d):
    return layout.distinct_pages(table(spark, d, "pages"))


def _contents(spark, d):
    return contents.distinct_contents(table(spark, d, "contents"))


def _sentences(spark, d):
    return structure.block_sentences(oriented(spark, d))


def _near(spark, d):
    return contents.nearest_captions(_contents(spark, d), contents.captions(oriented(spark, d)))


def main_font_size(s, d):
    return layout.main_font_sizes(_blocks(s, d))


def document_font_mode(s, d):
    return layout.document_font_modes(_blocks(s, d))


def page_origin(s, d):
    return layout.page_origins(_blocks(s, d), _pages(s, d))


def coordinate_flip(s, d):
    return oriented(s, d).select("block_id", "top", "bottom")


def header_footer_filter(s, d):
    return layout.flagged(oriented(s, d))


def valid_sentences(s, d):
    return layout.valid(oriented(s, d)).select("block_id", "doc_id", "page_id", "text")


def page_break_identifier(s, d):
    return layout.page_breaks(oriented(s, d), table(s, d, "pages"))


def caption_blocks(s, d):
    return layout.heading_blocks(oriented(s, d)).select("block_id", "path")


def document_title(s, d):
    return layout.document_titles(_blocks(s, d))


def lang_detect(s, d):
    return _blocks(s, d).select("block_id", T.language(F.col("text")).alias("lang"))


def normalize_text(s, d):
    return _blocks(s, d).select("block_id", T.normalised(F.col("text")).alias("text"))


def sentence_split(s, d):
    return _sentences(s, d)


def length_divide(s, d):
    return structure.divided(oriented(s, d))


def paragraph_islands(s, d):
    return structure.paragraph_islands(oriented(s, d))


def toc_span(s, d):
    return structure.toc_blocks(oriented(s, d))


def headlines(s, d):
    return structure.headlines(oriented(s, d))


def paragraph_heads(s, d):
    o = materialise(oriented(s, d))
    return structure.marked_heads(o, *classify.feature_traits(o, _pages(s, d))).select(
        "block_id", "is_headline", "page_changed", "is_head", "after_end", "marked"
    )


def index_regex_hist(s, d):
    return classify.index_histogram(oriented(s, d))


def caption_hist(s, d):
    return classify.caption_histogram(oriented(s, d))


def adopted_index(s, d):
    return classify.adopted_rules(classify.index_hits(oriented(s, d))).select("doc_id", "feature", "level", "rule")


def index_coordinates(s, d):
    c = classify.adopted_coordinates(classify.index_hits(oriented(s, d)))
    return c.select("doc_id", "feature", F.concat_ws(",", F.transform("x0s", lambda x: x.cast("string"))).alias("x0s"), "frequency")


def document_feature(s, d):
    return classify.document_features(oriented(s, d), _pages(s, d))


def slide_vote(s, d):
    return classify.slide_votes(_pages(s, d))


def label_extract(s, d):
    b = _blocks(s, d).where(T.exists_label(F.col("text")))
    return b.select("block_id", F.posexplode(T.labels(F.col("text"))).alias("label_no", "label"))


def caption_labels(s, d):
    return contents.captions(oriented(s, d)).select("block_id", "label", F.col("meta")[0].alias("meta"))


def nearest_caption(s, d):
    n = _near(s, d)
    return n.select("content_id", "upper_label", F.round("upper_distance", 6).alias("upper_distance"), "lower_label", F.round("lower_distance", 6).alias("lower_distance"))


def label_vote(s, d):
    return contents.label_votes(_contents(s, d), _near(s, d))


def label_assign(s, d):
    a = contents.assign_labels(_contents(s, d), contents.captions(oriented(s, d)))
    return a.select("doc_id", "kind", "content_id", "label", F.concat_ws("|", "meta").alias("meta"))


def nearest_text(s, d):
    n = contents.nearest_texts(_contents(s, d), oriented(s, d), document_font_mode(s, d))
    return n.select("content_id", "block_id", F.round("distance", 6).alias("distance"))


def content_geometry(s, d):
    return contents.checked_geometry(_contents(s, d), oriented(s, d), table(s, d, "pages"))


def table_normalize(s, d):
    return contents.normal_cells(table(s, d, "cells"))


def contents_by_label(s, d):
    return contents.by_label(_contents(s, d))


def content_urls(s, d):
    return contents.stored_paths(_contents(s, d), BASE_URL)


def label_link(s, d):
    return links.label_links(_sentences(s, d), _contents(s, d))


def unreferenced_contents(s, d):
    return links.unreferenced(_sentences(s, d), _contents(s, d)).select("content_id", "doc_id", "page_id", "label")


def no_reference_pages(s, d):
    return links.unreferenced_pages(_sentences(s, d), _contents(s, d))


def pages_with_sentences(s, d):
    return links.speaking_pages(_sentences(s, d))


def pages_without_sentences(s, d):
    return links.silent_pages(_sentences(s, d), table(s, d, "pages"))


def _marked(s, d):
    o = materialise(oriented(s, d))
    return structure.marked_heads(layout.valid(o), *classify.feature_traits(o, _pages(s, d)))


def references(s, d):
    return refs.references(oriented(s, d))


def reference_gate(s, d):
    return refs.gate(oriented(s, d))


def paragraph_exact(s, d):
    return paragraphs.paragraphs(_marked(s, d))


def sentence_exact(s, d):
    return paragraphs.exact_sentences(_marked(s, d))


def knowledge(s, d):
    return analyze(table(s, d, "blocks"), table(s, d, "pages"), table(s, d, "contents"), cells=table(s, d, "cells"))


def table_tsv(s, d):
    return tables_as_tsv(table(s, d, "cells"))


def bundle_blocks(s, d):
    return bundle_tables(table(s, d, "bundles"))[0].drop("block_id")  # a hash; doc_id and ord say the same


def bundle_pages(s, d):
    return bundle_tables(table(s, d, "bundles"))[1]


def bundle_contents(s, d):
    return bundle_tables(table(s, d, "bundles"))[2].drop("label", "meta")  # not known before captions are


def bundle_knowledge(s, d):
    return analyze_bundles(table(s, d, "bundles"))


QUERIES = {
    f.__name__: f
    for f in (
        sentence_split, main_font_size, document_font_mode, page_origin, coordinate_flip, header_footer_filter, valid_sentences,
        page_break_identifier, caption_blocks, document_title, lang_detect, normalize_text, length_divide, paragraph_islands,
        toc_span, headlines, paragraph_heads, index_regex_hist, caption_hist, adopted_index, index_coordinates, document_feature,
        slide_vote, label_extract, caption_labels, nearest_caption, label_vote, label_assign, nearest_text, content_geometry,
        table_normalize, contents_by_label, content_urls, label_link, unreferenced_contents, no_reference_pages,
        pages_with_sentences, pages_without_sentences, references, reference_gate, paragraph_exact, sentence_exact, knowledge, table_tsv,
        bundle_blocks, bundle_pages, bundle_contents, bundle_knowledge,
    )
}

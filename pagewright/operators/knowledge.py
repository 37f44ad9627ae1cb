"""Knowledge records: sentences with the figures and tables they mention and their page's context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import classify, contents as C, layout, paragraphs, references, structure
from pagewright.operators.links import labelled
from pagewright.plans.session import materialise

NO_REFERENCE_LANG = "@@_#1"


def _items(c: DataFrame, base_url: str, surface, whole: bool):
    size = F.when(F.col("kind") == "IMAGE", F.struct(
        F.lit(0).alias("x"), F.lit(0).alias("y"),
        (F.col("x1").cast("int") - F.col("x0").cast("int")).alias("width"), (F.col("y1").cast("int") - F.col("y0").cast("int")).alias("height"),
    ))
    return F.struct(
        F.col("ord"), F.col("content_id").alias("id"), F.col("url"), surface.alias("surface"), F.lit(whole).alias("is_whole"),
        size.alias("area"), F.coalesce("meta", F.array().cast("array<string>")).alias("meta"),
    )


def _both(items: str):
    pick = lambda k: F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col(items))))
    return pick("IMAGE").alias("images"), pick("TABLE").alias("tables")


def page_context(o: DataFrame, refs: DataFrame, toc: DataFrame) -> DataFrame:
    """(doc_id, page_id, references, toc, headlines, title): one row per page."""
    r = refs.where("reference is not null").groupBy("doc_id", "page_id").agg(F.sort_array(F.collect_list(F.struct("seq", "reference"))).alias("r"))
    t = structure.toc_entries(o, toc).groupBy("doc_id", "page_id").agg(F.sort_array(F.collect_list(F.struct("ord", "entry"))).alias("t"))
    h = structure.headlines(o).join(o.select("block_id", "doc_id", "page_id", "ord"), "block_id")
    h = h.groupBy("doc_id", "page_id").agg(F.sort_array(F.collect_list(F.struct("ord", "headline"))).alias("h"))
    p = o.select("doc_id", "page_id", "title").dropDuplicates(["doc_id", "page_id"])
    for x in (r, t, h):
        p = p.join(x, ["doc_id", "page_id"], "left")
    empty = F.array().cast("array<string>")
    return p.select(
        "doc_id", "page_id", F.coalesce("r.reference", empty).alias("references"), F.coalesce("t.entry", empty).alias("toc"),
        F.coalesce("h.headline", empty).alias("headlines"), "title",
    )


def document_context(pages: DataFrame, base_url: str, files: DataFrame | None = None) -> DataFrame:
    """(doc_id, document): id, file name (of files: doc_id, filename), address and the title of the first page that has one."""
    titled = F.min_by("title", F.when(F.col("title") != "", F.struct("page_ord", "page_id")))
    d = layout.distinct_pages(pages).groupBy("doc_id").agg(titled.alias("title"))
    if files is not None:
        d = d.join(files.groupBy("doc_id").agg(F.min("filename").alias("filename")), "doc_id", "left")
    else:
        d = d.withColumn("filename", F.lit(None).cast("string"))
    url = F.concat(F.lit(base_url.rstrip("/") + "/documents/"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return d.select("doc_id", F.struct(F.col("doc_id").alias("id"), "filename", url.alias("url"), F.coalesce("title", F.lit("")).alias("title")).alias("document"))


def knowledge(
    blocks: DataFrame, pages: DataFrame, contents: DataFrame, base_url: str = "http://contents.example", deep: bool = False,
    cells: DataFrame | None = None, images: DataFrame | None = None, every_caption: bool = False,
    files: DataFrame | None = None, page_break_stop: bool = False,
) -> DataFrame:
    """One row per sentence of every document, and one stand-in row per page with contents nobody mentions.

    (doc_id, proposition_id, section, para_no, sent_no, page_id, sentence, lang, images, tables, page, document).
    Blocks of tables of contents and reference lists are taken out first, headlines are cut out of the text. A document
    has no limit of size: see ``paragraphs``. Contents are checked and take the label of their caption: see
    ``contents.selected``; with every_caption each text with a label is one. page_break_stop: see ``stopped_at_breaks``.
    """
    o = materialise(layout.oriented(blocks, pages))
    toc = materialise(structure.toc_blocks(o))
    refs = materialise(references.references(o))
    gone = toc.select("block_id").unionByName(refs.where("block_id is not null").select("block_id")).dropDuplicates()
    text = o.join(gone, "block_id", "left_anti")
    text = materialise(text.where(~F.coalesce(F.col("path").rlike(T.TABLE_PATH), F.lit(False))))
    marked = structure.marked_heads(text, *classify.feature_traits(text, layout.distinct_pages(pages)))
    if page_break_stop:
        marked = structure.stopped_at_breaks(marked)
    s = materialise(paragraphs.exact_sentences(marked, deep))
    key = ["doc_id", "section", "para_no", "sent_no"]
    c = materialise(C.selected(C.distinct_contents(contents), text, pages, C.captions(o, every_caption), cells, images))
    c = labelled(c).join(C.stored_paths(c, base_url).select("content_id", "url"), "content_id").withColumn("meta", F.col("meta"))
    said = materialise(s.where(T.exists_label(F.col("sentence"))).select(*key, F.explode(T.labels(F.col("sentence"))).alias("label")))
    hit = said.join(c.where("label <> ''"), ["doc_id", "label"])
    once = Window.partitionBy(*key, "url").orderBy("ord", "content_id")
    hit = hit.withColumn("n", F.row_number().over(once)).where("n = 1").withColumn("item", _items(c, base_url, F.col("label"), False))
    per = hit.groupBy(*key).agg(*_both("item"))
    context = materialise(page_context(o, refs, toc))
    page = F.struct(F.col("page_id").alias("page_no"), "references", "toc", "headlines", "title")
    rows = s.join(per, key, "left").join(context, ["doc_id", "page_id"], "left")
    rows = rows.select(*key, "page_id", "sentence", "lang", "images", "tables", page.alias("page"))
    # Contents without label or whose label no sentence mentions, each address once per document.
    bare = c.join(said.select("doc_id", "label").dropDuplicates(), ["doc_id", "label"], "left_anti")
    w = Window.partitionBy("doc_id", "url").orderBy("page_id", "ord", "content_id")
    bare = bare.withColumn("n", F.row_number().over(w)).where("n = 1").withColumn("item", _items(c, base_url, F.lit(""), True))
    per_page = bare.groupBy("doc_id", "page_id").agg(*_both("item"))
    silent = context.where("size(references) + size(toc) + size(headlines) > 0").join(s.select("doc_id", "page_id").dropDuplicates(), ["doc_id", "page_id"], "left_anti")
    left = context.join(per_page, ["doc_id", "page_id"], "left").join(silent.select("doc_id", "page_id", F.lit(True).alias("silent")), ["doc_id", "page_id"], "left")
    left = left.where("images is not null or silent").select(
        "doc_id", F.lit(-1).cast("long").alias("section"), F.lit(-1).alias("para_no"), F.lit(-1).alias("sent_no"), "page_id",
        F.concat_ws("_", F.lit("NO_REFERENCE"), F.col("doc_id").cast("string"), F.col("page_id").cast("string")).alias("sentence"),
        F.lit(NO_REFERENCE_LANG).alias("lang"), "images", "tables", page.alias("page"),
    )
    # The same sentence has the same id in every run.
    id_ = F.sha2(F.concat_ws("/", "doc_id", *key[1:], "page_id"), 256).alias("proposition_id")
    every = rows.unionByName(left).join(document_context(pages, base_url, files), "doc_id", "left")
    return every.select("doc_id", id_, *key[1:], "page_id", "sentence", "lang", "images", "tables", "page", "document")

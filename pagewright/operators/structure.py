"""Tables of contents, paragraph heads and paragraphs of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators.classify import adopted_rule_matches
from pagewright.operators.layout import body, in_margin, valid
from pagewright.operators.ordered import carry_forward, previous

#: A line that is a list mark with its period and blank (fixed values: the marks and abbreviations that end no sentence).
_MARKS = r"[0-9]+|\([0-9]+\)|[0-9]+\)|[①-⑩]|[\x{2160}-\x{217F}]+|[IXV]+|[ixv]+|\s?[a-rA-R]\)?|\([a-rA-R]\)"
_SHORT_FORMS = r"Fig|FIG|fig|etc|ex|cf|e\.g|i\.e|s\.t|et\sal|et\sseq|U\.S|U\.S\.A|U\.K|u\.s|u\.s\.a|u\.k"
INDEX_LINE = rf"^(?:{_MARKS}|{_SHORT_FORMS})\.\s$"
TOC_WORDS = ("目次", "contents", "table of contents", "toc")


def toc_blocks(o: DataFrame) -> DataFrame:
    """(doc_id, page_id, block_id) of each document's table of contents.

    A document has one if a block lies under a TOC path or is a heading that says so. Its lines are the blocks on
    TOC paths, up to and including the first page on which another block follows one. Three map-side combined
    aggregates per document and no window, so a large document is many partial sums.
    """
    says = T.half_width(F.lower(F.trim("text"))).isin(*TOC_WORDS) & (F.col("font_size") >= F.col("main_font_size"))
    has = o.where(F.col("path").startswith("//Document/TOC") | says).select("doc_id").dropDuplicates()
    b = o.where(~in_margin()).withColumn("is_toc", F.col("path").rlike(T.TOC_PATH))
    at = F.struct("page_ord", "ord")
    first = b.where("is_toc").groupBy("doc_id").agg(F.min(at).alias("first_toc"))
    b = b.join(has, "doc_id", "left_semi").join(first, "doc_id")
    finish = b.where(~F.col("is_toc") & (at > F.col("first_toc"))).groupBy("doc_id").agg(F.min("page_ord").alias("finish"))
    return (
        b.where("is_toc")
        .join(finish, "doc_id", "left")
        .where(F.col("finish").isNull() | (F.col("page_ord") <= F.col("finish")))
        .select("doc_id", "page_id", "block_id")
    )


def marked_heads(o: DataFrame, features: DataFrame, adopted_x0: DataFrame) -> DataFrame:
    """Body blocks with what makes a paragraph begin there.

    features: (doc_id, feature, level, rule, long_proposition, page_division, only_headers); adopted_x0: (doc_id, x0s).
    Columns: is_headline, page_changed, is_head, after_end (the block before on the page ended a sentence), rest (what
    is left of a headline's text), marked. Headlines are cut out of the text: only their rest goes on.
    """
    lang = T.language(F.col("text"))
    b = body(o).select(
        "doc_id", "page_id", "page_ord", "ord", "block_id", "path", "text", "x0", "title", lang.alias("lang")
    ).join(features, "doc_id").join(adopted_x0, "doc_id", "left")
    page = Window.partitionBy("doc_id", "page_id").orderBy("ord")
    ends = T.ends_sentence(F.col("text"), F.col("lang"))
    b = b.withColumn("after_end", F.coalesce(F.lag(ends).over(page), F.lit(False)))
    b = previous(b, F.col("page_id"), "prev_page", ["page_ord", "ord"])
    head_line = T.is_headline(F.col("path"), F.col("text"), F.col("lang"))
    near = F.exists(F.coalesce("x0s", F.array().cast("array<int>")), lambda x: F.abs(x - F.col("x0")) < 5)
    place = F.when(F.col("only_headers"), head_line).otherwise(F.col("path").rlike(T.BODY_PATH))
    by_rule = place & (~F.col("long_proposition") | near) & adopted_rule_matches(F.col("text"))
    changed = F.col("page_id") != F.coalesce("prev_page", F.lit(1))
    b = b.select("*", head_line.alias("is_headline"), changed.alias("page_changed"))
    b = b.withColumn("is_head", F.when(F.col("page_division"), F.col("page_changed")).otherwise(by_rule))
    b = b.withColumn("rest", F.when(F.col("is_headline"), T.headline(F.trim("text"))["rest"]))
    marked = (
        F.when(F.col("is_headline"), F.when(F.col("is_head"), F.concat(F.lit("~  "), F.col("rest"))).otherwise(F.col("rest")))
        .when(F.col("is_head"), T.paragraph_mark(F.col("text"), F.col("after_end")))
        .when(~F.col("long_proposition"), T.paragraph_mark(F.col("text"), F.lit(True)))
        .otherwise(F.col("text"))
    )
    return b.select(
        "doc_id", "page_id", "page_ord", "ord", "block_id", "text", "lang", "is_headline", "page_changed", "is_head", "after_end",
        "rest", "long_proposition", "page_division", "path", marked.alias("marked"),
    )


def stopped_at_breaks(b: DataFrame) -> DataFrame:
    """Blocks of each page up to the first whose path is that of the page's last one; the page's text goes on, if at all,
    on the next page. Where paths number their elements that is the last block; where they do not, blocks are lost, so
    this is only done where asked for. b: the blocks of ``marked_heads``.
    """
    body_path = F.when(~F.col("path").rlike("Figure|Table|Footnote"), F.col("path"))
    page = Window.partitionBy("doc_id", "page_id")
    b = b.withColumn("_break", F.max_by(body_path, F.when(body_path.isNotNull(), F.col("ord"))).over(page))
    stop = F.min(F.when(F.col("path") == F.col("_break"), F.col("ord"))).over(page)
    return b.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("ord") <= F.col("_stop"))).drop("_break", "_stop")


def toc_entries(o: DataFrame, toc: DataFrame) -> DataFrame:
    """(doc_id, page_id, ord, entry): lines of tables of contents; a list mark alone leads in the line after it, also
    across pages, and without one it gives no entry."""
    t = toc.join(o.select("block_id", "page_ord", "ord", F.regexp_replace("text", "\n", "").alias("line")), "block_id")
    mark = F.concat(F.trim("line"), F.lit(" ")).rlike(INDEX_LINE)
    t = previous(t.withColumn("mark", mark), F.col("mark"), "after_mark", ["page_ord", "ord"])
    begins = ~F.coalesce("after_mark", F.lit(False))
    t = carry_forward(t, F.when(begins, F.col("block_id")), "entry_of", ["page_ord", "ord"])
    whole = t.groupBy("doc_id", "entry_of").agg(F.sort_array(F.collect_list(F.struct("page_ord", "ord", "page_id", "line", "mark"))).alias("x"))
    last = F.element_at("x", -1)
    return whole.where(~last["mark"]).select("doc_id", last["page_id"].alias("page_id"), last["ord"].alias("ord"), F.concat_ws("", "x.line").alias("entry"))


def headlines(o: DataFrame) -> DataFrame:
    """(block_id, headline, rest) of the headlines."""
    b = body(o).withColumn("lang", T.language(F.col("text")))
    h = T.headline(F.trim("text"))
    return b.where(T.is_headline(F.col("path"), F.col("text"), F.col("lang"))).select("block_id", h["headline"].alias("headline"), h["rest"].alias("rest"))


def paragraph_islands(o: DataFrame) -> DataFrame:
    """Paragraphs where borders fall between blocks: after a block that ends a sentence, and before a headline.

    (doc_id, first_block, n_blocks, n_chars, first_page, last_page). The start of each block's island is carried
    forward chunk by chunk, so no task holds a whole document.
    """
    b = valid(o).withColumn("lang", T.language(F.col("text")))
    ends = T.ends_sentence(F.col("text"), F.col("lang"))
    b = b.select("doc_id", "page_id", "page_ord", "ord", "block_id", "path", "text", "lang", ends.alias("ends"))
    b = previous(b, F.col("ends"), "prev_ends", ["page_ord", "ord"])
    start = F.coalesce("prev_ends", F.lit(True)) | T.is_headline(F.col("path"), F.col("text"), F.col("lang"))
    b = carry_forward(b, F.when(start, F.col("block_id")), "first_block", ["page_ord", "ord"])
    return b.groupBy("doc_id", "first_block").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"),
        F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page"),
    )


def block_sentences(o: DataFrame) -> DataFrame:
    """(doc_id, page_id, block_id, sent_no, sentence) of the valid blocks; all in one stage after the page join."""
    b = valid(o).withColumn("t", T.normalised(F.col("text")))
    s = T.sentences(F.col("t"), T.language(F.col("t")))
    return b.select("doc_id", "page_id", "block_id", F.posexplode(s).alias("sent_no", "sentence"))


def divided(o: DataFrame) -> DataFrame:
    """(block_id, chunk_no, chunk): normalised texts in pieces of the length their language allows."""
    b = valid(o).withColumn("t", T.normalised(F.col("text")))
    most = F.when(T.language(F.col("t")) == T.LANG_JA, T.MAX_CHARS_JA).otherwise(T.MAX_CHARS_OTHER)
    return b.where("t <> ''").select("block_id", F.posexplode(T.chunks(F.col("t"), most)).alias("chunk_no", "chunk"))

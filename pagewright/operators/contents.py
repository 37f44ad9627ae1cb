"""Figures and tables: geometry checks, captions, labels, links, normalised cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators.layout import FOOTER_RATIO, HEADER_RATIO, distinct_pages, in_margin
from pagewright.plans.session import materialise

RADIUS = 150.0
ASPECT = (1 / 20, 20.0)
OVERLAP_AREA, OVERLAP_CHARS = 10.0, 100


def distinct_contents(contents: DataFrame) -> DataFrame:
    """Each content once, with the engine's columns alone."""
    cols = ("doc_id", "page_id", "ord", "content_id", "kind", "label", "path", "x0", "y0", "x1", "y1", "meta")
    return contents.select(*cols).dropDuplicates(["content_id"])


def captions(o: DataFrame, every_text: bool = False) -> DataFrame:
    """One row per label of each caption block: (doc_id, page_id, ord, block_id, label_no, label, meta, x0, y0).

    With every_text each text with a label is a caption, whatever its path.
    """
    b = (o if every_text else o.where(F.col("path").rlike("/Caption"))).where(T.exists_label(F.col("text")))
    return b.select(
        "doc_id", "page_id", "ord", "block_id", F.posexplode(T.labels(F.col("text"))).alias("label_no", "label"),
        F.array(F.trim("text")).alias("meta"), "x0", F.col("top").alias("y0"),
    )


def _distances(contents: DataFrame, caps: DataFrame) -> DataFrame:
    """Content and caption pairs of one page, with the distance from the caption's corner to both left corners.

    The join is on (document, page), of which a page has a handful of either side; pairs beyond the radius go.
    """
    no = F.col("label_no") if "label_no" in caps.columns else F.lit(0)  # the place among the labels of one text
    c = caps.select("doc_id", "page_id", F.col("ord").alias("cap_ord"), no.alias("cap_no"), F.col("label").alias("cap_label"), F.col("meta").alias("cap_meta"), F.col("x0").alias("lx"), F.col("y0").alias("ly"))
    d = contents.join(c, ["doc_id", "page_id"])
    return d.select(
        "doc_id", "page_id", "kind", "content_id", "cap_ord", "cap_no", "cap_label", "cap_meta",
        F.hypot(F.col("x0") - F.col("lx"), F.col("y0") - F.col("ly")).alias("upper"),
        F.hypot(F.col("x0") - F.col("lx"), F.col("y1") - F.col("ly")).alias("lower"),
    )


def nearest_captions(contents: DataFrame, caps: DataFrame, radius: float = RADIUS) -> DataFrame:
    """(content_id, upper_label, upper_distance, lower_label, lower_distance); null where none is within the radius."""
    d = _distances(contents, caps)
    near = lambda side: F.when(F.col(side) < radius, F.struct(side, "cap_ord", "cap_label"))
    best = d.groupBy("content_id").agg(F.min(near("upper")).alias("u"), F.min(near("lower")).alias("l"))
    return contents.select("content_id").join(best, "content_id", "left").select(
        "content_id", F.col("u.cap_label").alias("upper_label"), F.col("u.upper").alias("upper_distance"),
        F.col("l.cap_label").alias("lower_label"), F.col("l.lower").alias("lower_distance"),
    )


def label_votes(contents: DataFrame, near: DataFrame) -> DataFrame:
    """(doc_id, kind, n_upper, n_lower, use_upper): whether captions stand above or below, per document and kind."""
    inf = F.lit(float("inf"))
    u, lo = F.coalesce("upper_distance", inf), F.coalesce("lower_distance", inf)
    return (
        contents.select("content_id", "doc_id", "kind")
        .join(near, "content_id")
        .groupBy("doc_id", "kind")
        .agg(F.sum((u <= lo).cast("long")).alias("n_upper"), F.sum((lo <= u).cast("long")).alias("n_lower"))
        .withColumn("use_upper", F.col("n_upper") > F.col("n_lower"))
    )


_ASSIGNED = "content_id string, up_label string, up_meta array<string>, up_least double, low_label string, low_meta array<string>, low_least double"
_ARROW = pa.schema([
    ("content_id", pa.string()), ("up_label", pa.string()), ("up_meta", pa.list_(pa.string())), ("up_least", pa.float64()),
    ("low_label", pa.string()), ("low_meta", pa.list_(pa.string())), ("low_least", pa.float64()),
])


def _nearest_unused(caps: list[dict], side: str, radius: float, used: set[str]) -> tuple[str, list[str], float]:
    least, label, meta = min(((c[side], c["cap_label"], c["cap_meta"]) for c in caps if c[side] < radius and c["cap_label"] not in used), key=lambda x: x[0], default=(math.inf, "", []))
    return label, meta, least


def assign_labels(contents: DataFrame, caps: DataFrame, radius: float = RADIUS) -> DataFrame:
    """(doc_id, kind, content_id, label, meta): labels of contents, with labels used up as the order of pages goes.

    Upper labels count as used from the next page on, lower ones at once but only within their page. So pages depend on
    each other only through labels that captions of several of a document's pages bear: just those pages are read one
    after the other, as a stream that holds the labels used so far; every other page is a unit of its own. Whether
    captions stand above or below is then a sum per document and kind.
    """
    near = materialise(_distances(contents, caps).where((F.col("upper") < radius) | (F.col("lower") < radius)))
    each = near.groupBy("content_id").agg(
        F.sort_array(F.collect_list(F.struct("cap_ord", "cap_no", "cap_label", "cap_meta", "upper", "lower"))).alias("caps")
    )
    shared = near.groupBy("doc_id", "kind", "cap_label").agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi")).where("lo <> hi")
    coupled = near.join(shared, ["doc_id", "kind", "cap_label"], "left_semi").select("doc_id", "kind", "page_id").dropDuplicates().withColumn("coupled", F.lit(True))
    key = ["doc_id", "kind", "unit"]
    fed = contents.select("doc_id", "kind", "page_id", "ord", "content_id").join(each, "content_id").join(coupled, ["doc_id", "kind", "page_id"], "left")
    fed = fed.withColumn("unit", F.when(F.col("coupled"), F.lit(-1)).otherwise(F.col("page_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, page = None, None
        used: set[str] = set()  # above: on pages before
        now: set[str] = set()  # above: on this page
        low: set[str] = set()
        for b in batches:
            rows = []
            for r in b.to_pylist():
                here = (r["doc_id"], r["kind"], r["unit"])
                if here != unit:
                    unit, page, used, now = here, None, set(), set()
                if r["page_id"] != page:
                    page, used, now, low = r["page_id"], used | now, set(), set()
                up = _nearest_unused(r["caps"], "upper", radius, used)
                down = _nearest_unused(r["caps"], "lower", radius, low)
                now.add(up[0])
                low.add(down[0])
                rows.append((r["content_id"], *up, *down))
            cols = [*zip(*rows)] if rows else [[]] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)

    streamed = fed.select(*key, "page_id", "ord", "content_id", "caps").repartition(*key).sortWithinPartitions(*key, "page_id", "ord", "content_id")
    got = contents.select("doc_id", "kind", "content_id").join(streamed.mapInArrow(run, _ASSIGNED), "content_id", "left")
    u, lo = F.coalesce("up_least", F.lit(math.inf)), F.coalesce("low_least", F.lit(math.inf))
    above = F.sum((u <= lo).cast("long")) > F.sum((lo <= u).cast("long"))
    votes = got.groupBy(F.col("doc_id").alias("_doc"), F.col("kind").alias("_kind")).agg(above.alias("above"))
    pick = lambda a, b, none: F.coalesce(F.when(F.col("above"), F.col(a)).otherwise(F.col(b)), none)
    return got.join(votes, F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("kind").eqNullSafe(F.col("_kind"))).select(
        "doc_id", "kind", "content_id", pick("up_label", "low_label", F.lit("")).alias("label"),
        pick("up_meta", "low_meta", F.array().cast("array<string>")).alias("meta"),
    )


def nearest_texts(contents: DataFrame, o: DataFrame, font_modes: DataFrame) -> DataFrame:
    """(content_id, block_id, distance): the text block nearest to each unlabelled content; null where its page has none."""
    bare = contents.where("label is null or label = ''")
    b = o.join(font_modes, "doc_id").where(~in_margin() & (F.col("font_size") >= F.col("font_mode")))
    b = b.select("doc_id", "page_id", "block_id", F.col("ord").alias("b_ord"), F.col("x0").alias("bx"), F.col("top").alias("by"))
    d = bare.join(b, ["doc_id", "page_id"]).withColumn("distance", F.hypot(F.col("x0") - F.col("bx"), F.col("y0") - F.col("by")))
    best = d.groupBy("content_id").agg(F.min(F.struct("distance", "b_ord", "block_id")).alias("m"))
    return bare.select("content_id").join(best, "content_id", "left").select("content_id", "m.block_id", "m.distance")


def checked_geometry(contents: DataFrame, o: DataFrame, pages: DataFrame) -> DataFrame:
    """(content_id, in_margin, covers_text, odd_aspect, is_ok) by position and shape; tables are only checked for margins.

    A content of no width has no aspect and is not ok, where dividing by it would fail.
    """
    first = o.groupBy("doc_id", "page_id").agg(F.min_by(F.struct("x0", "top", "x1", "bottom", F.length("text").alias("n")), "ord").alias("f"))
    c = contents.join(distinct_pages(pages).select("doc_id", "page_id", "height"), ["doc_id", "page_id"]).join(first, ["doc_id", "page_id"], "left")
    w, h = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    area = F.abs(F.col("f.bottom") - F.col("f.top")) * F.abs(F.col("f.x1") - F.col("f.x0"))
    image = F.col("kind") == "IMAGE"
    covers = image & F.coalesce((F.abs(w * h - area) < OVERLAP_AREA) & (F.col("f.n") > OVERLAP_CHARS), F.lit(False))
    ratio = F.when(w > 0, h / w)
    odd = image & F.coalesce((ratio < ASPECT[0]) | (ratio > ASPECT[1]), F.lit(True))
    margin = in_margin(HEADER_RATIO, FOOTER_RATIO, "y0", "y1")
    return c.select("content_id", margin.alias("in_margin"), covers.alias("covers_text"), odd.alias("odd_aspect")).withColumn(
        "is_ok", ~F.col("in_margin") & ~F.col("covers_text") & ~F.col("odd_aspect")
    )


def selected(contents: DataFrame, o: DataFrame, pages: DataFrame, caps: DataFrame, cells: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """Contents that pass the checks, with label and meta of their caption; those delivered stay where no caption is near.

    A content that the geometry cannot judge (no position, no page) stays. With cells, tables go that are empty or of
    one row once normalised; with images (content_id, one_colour), images of one colour.
    """
    bad = checked_geometry(contents, o, pages).where("not is_ok").select("content_id")
    if images is not None:
        bad = bad.unionByName(images.where("one_colour").select("content_id")).dropDuplicates()
    c = contents.join(bad, "content_id", "left_anti")
    if cells is not None:
        full = normal_cells(cells).select("content_id").dropDuplicates().withColumn("full", F.lit(True))
        c = c.join(full, "content_id", "left").where("full or coalesce(kind <> 'TABLE', true)").drop("full")
    c = materialise(c)
    given = assign_labels(c, caps).where("label <> ''").select("content_id", F.col("label").alias("cap_label"), F.col("meta").alias("cap_meta"))
    c = c.join(given, "content_id", "left")
    c = c.withColumns({"label": F.coalesce("cap_label", "label"), "meta": F.coalesce("cap_meta", "meta")})
    return c.drop("cap_label", "cap_meta")


def normal_label(c):
    """A delivered label in half width and lower case, without blanks."""
    return F.replace(F.lower(T.half_width(c)), F.lit(" "), F.lit(""))


def normal_cells(cells: DataFrame) -> DataFrame:
    """Table cells with gaps filled downwards, export remains, tabs and line breaks gone; empty rows and columns dropped.

    A gap with nothing above becomes the text ``nan`` and so keeps its row. Tables of one row or none are dropped.
    """
    c = cells.select("content_id", "row_no", "col_no", "cell_value").dropDuplicates()
    w = Window.partitionBy("content_id", "col_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    v = F.coalesce(F.last("cell_value", ignorenulls=True).over(w), F.lit("nan"))
    v = F.regexp_replace(F.regexp_replace(v, "_x000D_", ""), r"^\s+|\s+$", "")
    v = F.regexp_replace(F.regexp_replace(v, "\t", " "), "\n", "")
    filled = c.select("content_id", "row_no", "col_no", v.alias("value"))
    full = filled.where("value <> ''")
    rows, cols = full.select("content_id", "row_no").dropDuplicates(), full.select("content_id", "col_no").dropDuplicates()
    kept = filled.join(cols, ["content_id", "col_no"], "left_semi").join(rows, ["content_id", "row_no"], "left_semi")
    several = rows.groupBy("content_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return kept.join(several, "content_id", "left_semi").select("content_id", "row_no", "col_no", F.when(F.col("value") != "", F.col("value")).alias("value"))


def by_label(contents: DataFrame) -> DataFrame:
    """(doc_id, label, content_ids): contents of each label, images first."""
    kind = F.when(F.col("kind") == "IMAGE", 0).otherwise(1)
    item = F.struct(kind.alias("k"), "ord", "content_id")
    label = F.coalesce(normal_label(F.col("label")), F.lit("")).alias("label")
    return contents.groupBy("doc_id", label).agg(F.sort_array(F.collect_list(item)).alias("x")).select("doc_id", "label", F.concat_ws(",", "x.content_id").alias("content_ids"))


def stored_paths(contents: DataFrame, base_url: str) -> DataFrame:
    """(content_id, stored_path, url): where a content is stored and its public address."""
    folder = F.when(F.col("kind") == "IMAGE", F.lit("contents/images/")).otherwise(F.lit("contents/tables/"))
    path = F.concat(folder, F.col("content_id"), F.when(F.col("kind") == "IMAGE", F.lit(".jpg")).otherwise(F.lit(".tsv")))
    return contents.select("content_id", path.alias("stored_path"), T.public_url(path, base_url).alias("url"))

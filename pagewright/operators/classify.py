"""Document types by rules: index and caption patterns, coordinates, slide vote.

Each rule is one condition column, so the patterns are constants of generated code; the rules take part in one
projection per block and one exchange on (document, rule).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import WHITE
from pagewright.operators.layout import body, heading_blocks
from pagewright.plans.session import materialise

JA_LEGAL, SLIDES, EN_LEGAL, GENERAL, OTHER = "japanese_legal", "presentation", "english_legal", "general", "other"
#: Priority, and whether paragraphs are long, pages are paragraphs, only headers start paragraphs (fixed values).
TRAITS = {
    JA_LEGAL: (10, True, False, False),
    SLIDES: (10, True, True, False),
    EN_LEGAL: (20, True, False, False),
    GENERAL: (100, False, False, True),
    OTHER: (1_000_000, False, False, False),
}
SLIDE_RATIOS, SLIDE_TOLERANCE, SLIDE_FONT, SLIDE_SHARE = (4 / 3, 16 / 9), 0.01, 16, 0.8
SPREAD, PERCENTILE, LEAST_HITS = 5, 0.8, 1


@dataclass(frozen=True)
class IndexRule:
    """A pattern of list marks that headings of a feature begin with; lower levels are tried first."""

    feature: str
    level: int
    no: int
    regex: str
    inner_min: int = 0  # least length of the first group, and what it may not hold
    inner_reject: str = ""

    def matches(self, text: Column) -> Column:
        hit = text.rlike(self.regex)
        if self.inner_min:
            inner = F.regexp_extract(text, self.regex, 1)
            hit = hit & (F.length(inner) >= self.inner_min) & ~inner.rlike(self.inner_reject)
        return hit


_SEP = r"[.\-\s\x{3000}]"
#: Patterns of list marks and captions (fixed values).
INDEX_RULES = (
    IndexRule(JA_LEGAL, 0, 0, r"^[(|【](.+?)[)|】].*$", 2, "[0-9a-zA-Z]"),
    IndexRule(JA_LEGAL, 1, 1, r"^第[0-9]*.*条"),
    IndexRule(EN_LEGAL, 0, 0, r"^(?:Article|ARTICLE)"),
    IndexRule(EN_LEGAL, 0, 1, rf"^[0-9].*\.{WHITE}"),
    IndexRule(EN_LEGAL, 0, 2, rf"^[\x{{2160}}-\x{{2169}}].*\.{WHITE}"),
    IndexRule(EN_LEGAL, 0, 3, rf"^[IXV]+\.{WHITE}"),
    IndexRule(GENERAL, 0, 0, rf"^[0-9]+{_SEP}.*{WHITE}"),
    IndexRule(GENERAL, 0, 1, rf"^[\x{{2160}}-\x{{2169}}]+{_SEP}.*{WHITE}"),
    IndexRule(GENERAL, 0, 2, rf"^[IXV]+{_SEP}.*{WHITE}"),
)
CAPTION_RULES = {JA_LEGAL: "契約書|同意書", EN_LEGAL: "Contract|CONTRACT|Agreement|AGREEMENT", GENERAL: "^.*"}


def _headings(o: DataFrame) -> DataFrame:
    return body(heading_blocks(o))


def index_hits(o: DataFrame, rules: tuple[IndexRule, ...] = INDEX_RULES) -> DataFrame:
    """(doc_id, feature, level, rule, x0) of each heading and rule that matches; a heading counts at its first level."""
    t = F.col("text")
    by: dict[str, dict[int, Column]] = {}
    for r in rules:
        levels = by.setdefault(r.feature, {})
        levels[r.level] = levels.get(r.level, F.lit(False)) | r.matches(t)
    hits = []
    for r in rules:
        earlier = F.lit(False)
        for level, hit in by[r.feature].items():
            if level < r.level:
                earlier = earlier | hit
        here = F.struct(F.lit(r.feature).alias("feature"), F.lit(r.level).alias("level"), F.lit(r.no).alias("rule"), F.lit(r.regex).alias("regex"))
        hits.append(F.when(r.matches(t) & ~earlier, here))
    found = F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")
    return _headings(o).select("doc_id", "x0", found).select("doc_id", "h.feature", "h.level", "h.rule", "h.regex", F.col("x0").cast("int").alias("x0"))


def index_histogram(o: DataFrame) -> DataFrame:
    return index_hits(o).groupBy("doc_id", "feature", "level", "rule").agg(F.count(F.lit(1)).alias("n_hits"))


def caption_histogram(o: DataFrame) -> DataFrame:
    """(doc_id, feature, n_captions): headings and, once per page, page titles that match a feature's captions."""
    titles = o.select("doc_id", "page_id", "title").where("title is not null").dropDuplicates().select("doc_id", F.col("title").alias("text"))
    texts = _headings(o).select("doc_id", "text").unionByName(titles)
    hits = F.array(*[F.when(F.col("text").rlike(p), F.lit(f)) for f, p in CAPTION_RULES.items()])
    return (
        texts.select("doc_id", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("feature"))
        .groupBy("doc_id", "feature")
        .agg(F.count(F.lit(1)).alias("n_captions"))
    )


def adopted_rules(hits: DataFrame) -> DataFrame:
    """(doc_id, feature, rule, regex): at the first level with hits the rule with most; of equals the first declared."""
    n = hits.groupBy("doc_id", "feature", "level", "rule", "regex").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct("level", "rule", "regex"), F.struct("level", -F.col("n"), "rule")).alias("b")
    return n.groupBy("doc_id", "feature").agg(best).select("doc_id", "feature", "b.level", "b.rule", "b.regex")


def adopted_coordinates(hits: DataFrame) -> DataFrame:
    """(doc_id, feature, x0s, frequency): where headings of the adopted rule begin.

    If the counts of the x0s differ by less than 5 all are kept, else those from the 80th percentile of counts on.
    """
    kept = hits.join(adopted_rules(hits), ["doc_id", "feature", "level", "rule", "regex"])
    per = kept.groupBy("doc_id", "feature", "x0").agg(F.count(F.lit(1)).alias("n"))
    bounds = per.groupBy("doc_id", "feature").agg(
        F.max("n").alias("hi"), F.min("n").alias("lo"), F.percentile("n", F.lit(PERCENTILE)).alias("p")
    )
    return (
        per.join(bounds, ["doc_id", "feature"])
        .where((F.col("hi") - F.col("lo") < SPREAD) | (F.col("n") >= F.col("p") - 1e-9))
        .groupBy("doc_id", "feature")
        .agg(F.sort_array(F.collect_list("x0")).alias("x0s"), F.sum("n").alias("frequency"))
    )


def slide_votes(pages: DataFrame) -> DataFrame:
    """(doc_id, slide_share, is_slides): share of pages of a slide's shape and font size."""
    ratio = F.col("width") / F.col("height")
    shape = F.lit(False)
    for r in SLIDE_RATIOS:
        shape = shape | (F.abs(ratio - F.lit(r)) < SLIDE_TOLERANCE)
    share = F.avg((shape & (F.col("main_font_size") > SLIDE_FONT)).cast("double"))
    return pages.groupBy("doc_id").agg(share.alias("slide_share")).withColumn("is_slides", F.col("slide_share") > SLIDE_SHARE)


def document_features(o: DataFrame, pages: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """(doc_id, feature, frequency) of each document of pages: slides first, else by priority, else other."""
    hits = index_hits(o) if hits is None else hits
    coords = adopted_coordinates(hits)
    ok = coords.join(caption_histogram(o), ["doc_id", "feature"]).where(F.col("frequency") > LEAST_HITS)
    prio = F.create_map(*[F.lit(x) for f, t in TRAITS.items() for x in (f, t[0])])
    best = (
        ok.withColumn("prio", prio[F.col("feature")])
        .groupBy("doc_id")
        .agg(F.min_by(F.struct("feature", "frequency"), F.struct("prio", -F.col("frequency"))).alias("b"))
    )
    return (
        slide_votes(pages)
        .join(best, "doc_id", "left")
        .select(
            "doc_id",
            F.when(F.col("is_slides"), SLIDES).otherwise(F.coalesce("b.feature", F.lit(OTHER))).alias("feature"),
            F.when(F.col("is_slides"), 0).otherwise(F.coalesce("b.frequency", F.lit(0))).cast("long").alias("frequency"),
        )
    )


def adopted_rule_matches(text: Column) -> Column:
    """Whether a text matches its document's adopted rule, with the rule's conditions on its first group.

    The rules are constants, chosen by feature, level and number, so no pattern is compiled row by row.
    """
    hit = F.lit(False)
    for r in INDEX_RULES:
        here = (F.col("feature") == r.feature) & (F.col("level") == r.level) & (F.col("rule") == r.no)
        hit = F.when(here, r.matches(text)).otherwise(hit)
    return F.coalesce(hit, F.lit(False))


def feature_traits(o: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What paragraph marking needs: (doc_id, feature, level, rule, traits), and (doc_id, x0s)."""
    hits = materialise(index_hits(o))
    features = document_features(o, pages, hits)
    trait = lambda k: F.create_map(*[F.lit(x) for f, t in TRAITS.items() for x in (f, t[k])])[F.col("feature")]
    rules = features.join(adopted_rules(hits).select("doc_id", "feature", "level", "rule"), ["doc_id", "feature"], "left")
    x0s = features.join(adopted_coordinates(hits), ["doc_id", "feature"]).select("doc_id", "x0s")
    return rules.select(
        "doc_id", "feature", "level", "rule", trait(1).alias("long_proposition"), trait(2).alias("page_division"), trait(3).alias("only_headers")
    ), x0s

from __future__ import annotations

import io
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from pagewright import api
from pagewright.functions import kernels as K
from pagewright.functions import text as T
from pagewright.operators import classify, contents, layout, paragraphs, references, structure
from pagewright.sources import files
from pagewright.sources.bundles import bundle_tables
from pagewright.streaming.bundle_stream import stream_nodes

BLOCK = "block_id long, doc_id long, page_id int, page_ord int, ord int, path string, text string, font_size double, x0 double, y0 double, x1 double, y1 double"
PAGE = "doc_id long, page_id int, page_ord int, width double, height double, main_font_size int, title string"


def blocks(spark, lines, doc=1, path="//Document/P", per_page=100):
    rows = []
    for k, line in enumerate(lines):
        p, t = line if isinstance(line, tuple) else (path, line)
        page = k // per_page + 1
        rows.append((k, doc, page, page, k, p, t, 12.0, 72.0, 100.0 + k % per_page, 500.0, 110.0 + k % per_page))
    return spark.createDataFrame(rows, BLOCK)


def pages(spark, n=1, doc=1, size=(612.0, 792.0), font=12, title=None):
    return spark.createDataFrame([(doc, k + 1, k + 1, *size, font, title) for k in range(n)], PAGE)


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("v")).first()[0]


@pytest.mark.parametrize(
    ("text", "lang"),
    [("The ferry.", "en_US"), ("船は出た。", "ja_JP"), ("12", ""), ("(3)", ""), ("Ⅳ", ""), ("вода", ""), ("", "en_US"), (None, None), ("вода and", "en_US")],
)
def test_language(spark, text, lang):
    assert one(spark, T.language, text) == lang
    if text is not None:
        assert K.language_of(text) == lang


def test_normalised(spark):
    assert one(spark, T.normalised, "Ａ‪b.\n  Ｃd (<http://x.example>)e") == "Ab. Cd e"
    assert one(spark, T.normalised, "船。　　出た") == "船。 出た"


@pytest.mark.parametrize(
    ("text", "want"),
    [("see fig. 1 and Fig. 12", ["fig.1"]), ("see fig. 12 and fig. 1", ["fig.12", "fig.1"]), ("fig.1, fig. 1", ["fig.1", "fig.1"]), ("Fig. ① and table ⑩", ["fig.1", "table10"]), ("Ｆｉｇ．１ Table-2", ["fig.1", "table-2"]), ("figfig 3", ["figfig3"]), ("図 4と表５", ["図4", "表5"]), ("none", [])],
)
def test_labels(spark, text, want):
    assert one(spark, T.labels, text) == want == api.getLabels(text)
    assert one(spark, T.exists_label, text) == bool(want) == api.existLabel(text)


def test_label_kernel_deletes_hits_everywhere():
    assert api.getLabels("fig. 1 and fig. 12") == ["fig.1"]
    assert api.getLabels(None) == [] and not api.existLabel(None)


def test_headline_and_marks(spark):
    long = "3. Alpha beta " + "gamma " * 12
    r = one(spark, T.headline, long)
    assert r["headline"] == "3. Alpha beta " and r["rest"].startswith("gamma")
    assert one(spark, lambda c: T.paragraph_mark(c, F.lit(False)), "Title") == "~  Title "
    assert one(spark, lambda c: T.paragraph_mark(c, F.lit(True)), "End.") == " End."


def test_chunks(spark):
    assert one(spark, lambda c: T.chunks(c, F.lit(4)), "abcdefghij") == ["abcd...", "efgh...", "ij"]
    assert one(spark, lambda c: T.chunks(c, F.lit(4)), "abcd") == ["abcd"]


def test_masks():
    stop = K.MASKS["."]
    assert K.masked_periods("See 3. Next one is here. ") == f"See 3{stop}Next one is here. "
    assert K.masked_periods("Done. No. Others follow here.") == f"Done{stop}No. Others follow here."
    assert K.masked_brackets("A (b. c) d. e", "en_US") == f"A (b{stop} c) d. e"
    assert K.masked_brackets("A b) c. d", "en_US") == "A b) c. d"
    for t in ("a (b. c! (d?)) e. f~ g", "et al. 3. x. y"):
        assert K.unmasked(K.masked(t, "en_US")).replace(" ", "") == t.replace(" ", "")


def test_spaced_ends():
    assert K.spaced_ends("End.", False, "en_US") == "End. "
    assert K.spaced_ends("船。出た。3.5だ。", False, "ja_JP") == f"船。 出た。 3{K.MASKS['.']}5だ。 "
    assert K.spaced_ends("x.", False, "") == "x."


def test_cut_numbered():
    assert K.cut_numbered("The parts: (1) hull (ii) mast Ⅳ) sail b) oar • rope") == ["The parts: ", "~", "(1) hull ", "~", "(ii) mast", "~", " Ⅳ) sail", "~", " b) oar", "~", " • rope", "~"]
    assert K.cut_numbered("mastⅣ) and xI) stay") == ["mastⅣ) and xI) stay"]
    assert K.cut_numbered("(1)") == ["(1)"] and K.cut_numbered("") == [""] and K.cut_numbered("no marks") == ["no marks"]


def test_divided_by_length():
    long = "あ" * 301
    got = K.divided_by_length([(long, 1), ("。", 1)], "ja_JP")
    assert got == [("あ" * 300 + "...", 1), ("あ。", 1)]
    assert K.divided_by_length([("Hi", 1), (".", 1), ("Longer text", 2)], "en_US") == [("Hi .", 1), ("Longer text", 2)]


def test_origin_and_margins(spark):
    b = spark.createDataFrame(
        [(1, 1, 1, 1, 1, "//Document/P", "top", 12.0, 72.0, 700.0, 500.0, 780.0), (2, 1, 1, 1, 2, "//Document/P", "mid", 12.0, 72.0, 300.0, 500.0, 310.0)], BLOCK
    )
    o = layout.oriented(b.unionByName(b), pages(spark))
    got = {r.block_id: (r.top, r.bottom) for r in o.collect()}
    assert got == {1: (12.0, 92.0), 2: (482.0, 492.0)}
    assert [r.block_id for r in layout.body(o).collect()] == [2]


def test_font_ties(spark):
    b = spark.createDataFrame(
        [(1, 1, 1, 1, 1, "p", "aaaa", 11.0, 0.0, 0.0, 0.0, 0.0), (2, 1, 1, 1, 2, "p", "bbbb", 9.0, 0.0, 0.0, 0.0, 0.0)], BLOCK
    )
    assert layout.main_font_sizes(b).first().main_font_size == 11
    assert layout.document_font_modes(b).first().font_mode == 9.0


def feature(spark, lines, title=None, **page):
    o = layout.oriented(blocks(spark, lines), pages(spark, title=title, **page))
    return classify.document_features(o, pages(spark, title=title, **page)).first().feature


def test_features(spark):
    h = "//Document/H1"
    assert feature(spark, [(h, f"{k}. Intro part ") for k in range(3)]) == "general"
    assert feature(spark, [(h, f"Article {k} of this") for k in range(5)], title="Service Agreement") == "english_legal"
    assert feature(spark, [(h, f"【目的事項】 第{k}") for k in range(3)], title="業務契約書") == "japanese_legal"
    assert feature(spark, ["plain"]) == "other"
    assert feature(spark, ["plain"], size=(960.0, 540.0), font=24) == "presentation"


def test_slide_vote_needs_more_than_four_fifths(spark):
    p = pages(spark, 8, size=(960.0, 540.0), font=24).unionByName(spark.createDataFrame([(1, 9, 9, 612.0, 792.0, 12, None), (1, 10, 10, 612.0, 792.0, 12, None)], PAGE))
    r = classify.slide_votes(p).first()
    assert r.slide_share == 0.8 and not r.is_slides


def test_toc_ends_after_the_first_page_with_other_blocks(spark):
    toc, p = "//Document/TOC/TOCI", "//Document/P"
    lines = [(toc, "1 a"), (toc, "2 b"), (toc, "3 c"), (p, "text"), (toc, "4 d"), (toc, "5 e")]
    o = layout.oriented(blocks(spark, lines, per_page=2), pages(spark, 3))
    assert {r.block_id for r in structure.toc_blocks(o).collect()} == {0, 1, 2}
    assert structure.toc_blocks(layout.oriented(blocks(spark, ["x"]), pages(spark))).count() == 0


def test_references(spark):
    lines = ["Body text here.", ("//Document/H1", "References"), "[2] First A, title.", "[3] Second B,", "more of it."]
    o = layout.oriented(blocks(spark, lines), pages(spark))
    r = references.references(o).collect()
    assert [x.reference for x in sorted((x for x in r if x.reference), key=lambda x: x.seq)] == ["[2] First A, title.", "[3] Second B,more of it."]
    assert {x.block_id for x in r if x.block_id is not None} == {2, 3, 4}


def test_references_without_marks(spark):
    lines = ["Body.", "References", "First A, title.", "Second B,", " more of it.", ("//Document/H1", "Appendix"), "Tail."]
    o = layout.oriented(blocks(spark, lines), pages(spark))
    r = references.references(o).collect()
    assert [x.reference for x in sorted((x for x in r if x.reference), key=lambda x: x.seq)] == ["First A, title.", "Second B, more of it."]


def test_paragraphs_close_at_block_borders(spark):
    lines = ["One two three.", "Four five", "six seven. Eight nine ten.", "Last line without end"]
    o = layout.oriented(blocks(spark, lines), pages(spark))
    m = structure.marked_heads(o, *classify.feature_traits(o, pages(spark)))
    p = sorted(paragraphs.paragraphs(m).collect(), key=lambda r: r.para_no)
    assert [r.total_text.split() for r in p] == [["One", "two", "three."], "Four five six seven. Eight nine ten.".split(), "Last line without end".split()]
    s = paragraphs.exact_sentences(m).orderBy("para_no", "sent_no").collect()
    assert [r.sentence.split() for r in s] == [["One", "two", "three."], "Four five six seven.".split(), "Eight nine ten.".split(), "Last line without end".split()]


def test_partition_count_does_not_matter(spark, data):
    b, p = spark.read.parquet(f"{data}/blocks.parquet"), spark.read.parquet(f"{data}/pages.parquet")
    got = []
    for n in ("1", "6"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, structure.paragraph_islands(layout.oriented(b, p)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] and got[0]


def test_tables(spark):
    cells = [("t", 0, 0, None), ("t", 0, 1, " a_x000D_ "), ("t", 1, 0, "x\ty"), ("t", 1, 1, None), ("t", 2, 0, " "), ("t", 2, 1, " "), ("u", 0, 0, "only")]
    df = spark.createDataFrame(cells, "content_id string, row_no int, col_no int, cell_value string")
    got = {(r.row_no, r.col_no): r.value for r in contents.normal_cells(df.unionByName(df)).collect()}
    assert got == {(0, 0): "nan", (0, 1): "a", (1, 0): "x y", (1, 1): "a"}
    assert files.tables_as_tsv(df).collect() == [("t", "nan\ta\nx y\ta")]


def test_xlsx(spark, tmp_path):
    sheet = '<worksheet xmlns="m"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row><row><c r="B2" t="inlineStr"><is><t>z</t></is></c></row></sheetData></worksheet>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>he</t><t>ad</t></si></sst>')
    (tmp_path / "t1.xlsx").write_bytes(data.getvalue())
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    got = {(r.content_id, r.row_no, r.col_no): r.cell_value for r in files.read_xlsx(spark, str(tmp_path)).collect()}
    assert got == {("t1", 0, 0): "head", ("t1", 0, 1): None, ("t1", 0, 2): "2.5", ("t1", 1, 0): None, ("t1", 1, 1): "z", ("t1", 1, 2): None}


def png(folder, name, pixels):
    import struct
    import zlib

    h, w = len(pixels), len(pixels[0])
    raw = b"".join(b"\0" + bytes(c for px in row for c in px) for row in pixels)
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    (folder / name).write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def xlsx(file, rows):
    cells = "".join(f'<row r="{r}">' + "".join(f'<c r="{"ABC"[c]}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
    with zipfile.ZipFile(file, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="m"><sheetData>{cells}</sheetData></worksheet>')


def test_folder_of_bundles_with_their_files(spark, tmp_path):
    import json

    el = lambda path, text, y: {"Page": 0, "Bounds": [72, y, 500, y + 20], "Path": path, "Text": text, "TextSize": 12}
    at = lambda path, y, *names: {"Page": 0, "Bounds": [72, y, 200, y + 60], "Path": path, "filePaths": list(names)}
    for name in ("one two", "other"):
        folder = tmp_path / name
        (folder / "figures").mkdir(parents=True)
        (folder / "tables").mkdir()
        elements = [
            el("//Document/P", "See fig. 1, fig. 2, table 3 and table 4.", 100), at("//Document/Figure", 200, "figures/a.png"), el("//Document/P", "Fig. 1 A.", 265),
            at("//Document/Figure[2]", 320, "figures/b.png"), el("//Document/P", "Fig. 2 B.", 385), at("//Document/Table", 440, "tables/t.xlsx"), el("//Document/P", "Table 3 T.", 505),
            at("//Document/Table[2]", 560, "tables/u.xlsx"), el("//Document/P", "Table 4 U.", 625),
        ]
        (folder / "structuredData.json").write_text(json.dumps({"pages": [{"page_number": 0, "width": 612, "height": 792}], "elements": elements}))
        varied = [[(k * 40, 255 - k * 40, k * 9) for k in range(4)]] * 4
        png(folder / "figures", "a.png", varied)
        png(folder / "figures", "b.png", [[(9, 9, 9)] * 4] * 4 if name == "other" else varied)
        xlsx(folder / "tables/t.xlsx", [["a", "b"], ["c", "d"]])
        xlsx(folder / "tables/u.xlsx", [["alone"]])
    k = [r for r in api.analyze_folder(spark, str(tmp_path)).collect() if r.sentence.startswith("See")]
    got = {r.document.filename.split("/")[-2]: ({i.surface for i in r.images}, {t.surface for t in r.tables}) for r in k}
    assert got == {"one%20two": ({"fig.1", "fig.2"}, {"table3"}), "other": ({"fig.1"}, {"table3"})}


def test_images(spark, tmp_path):
    png(tmp_path, "flat.png", [[(9, 9, 9)] * 4] * 4)
    png(tmp_path, "varied.png", [[(k * 40, 255 - k * 40, k * 9) for k in range(4)]] * 4)
    got = {r.path.rsplit("/", 1)[-1]: r.one_colour for r in files.read_images(spark, str(tmp_path)).collect()}
    assert got == {"flat.png": True, "varied.png": False}


def test_captions_used_up(spark):
    c = spark.createDataFrame(
        [(1, "IMAGE", 1, 1, "a", None, "p", 10.0, 10.0, 50.0, 50.0), (1, "IMAGE", 1, 2, "b", None, "q", 10.0, 60.0, 50.0, 100.0)],
        "doc_id long, kind string, page_id int, ord int, content_id string, label string, path string, x0 double, y0 double, x1 double, y1 double",
    )
    caps = spark.createDataFrame([(1, 1, 5, 9, "fig.1", ["Fig. 1"], 10.0, 55.0)], "doc_id long, page_id int, ord int, block_id long, label string, meta array<string>, x0 double, y0 double")
    near = {r.content_id: (r.upper_label, r.lower_label) for r in contents.nearest_captions(c, caps).collect()}
    assert near == {"a": ("fig.1", "fig.1"), "b": ("fig.1", "fig.1")}
    got = {r.content_id: r.label for r in contents.assign_labels(c, caps).collect()}
    assert got == {"a": "fig.1", "b": ""}


CONTENT = "doc_id long, kind string, page_id int, ord int, content_id string, label string, path string, x0 double, y0 double, x1 double, y1 double"
CAPTION = "doc_id long, page_id int, ord int, block_id long, label_no int, label string, meta array<string>, x0 double, y0 double"


def labels_by_force(contents_, caps):
    """Every content of a document and kind, one after the other."""
    out = {}
    for key in sorted({(c[0], c[1]) for c in contents_}):
        used, later, low, page, votes, up, down = set(), set(), set(), None, 0, {}, {}
        for c in sorted((c for c in contents_ if (c[0], c[1]) == key), key=lambda c: (c[2], c[3], c[4])):
            if c[2] != page:
                used, low, page = set(later), set(), c[2]
            best = []
            for y, gone in ((c[8], used), (c[10], low)):
                near = [(math.hypot(c[7] - k[7], y - k[8]), k[2], k[4], k[5]) for k in caps if k[0] == c[0] and k[1] == c[2] and k[5] not in gone]
                best.append(min((x for x in near if x[0] < 150), default=(math.inf, 0, 0, "")))
            up[c[4]], down[c[4]] = best[0][3], best[1][3]
            later |= {best[0][3]} - {""}
            low |= {best[1][3]} - {""}
            votes += (best[0][0] <= best[1][0]) - (best[1][0] <= best[0][0])
        out.update(up if votes > 0 else down)
    return out


def test_labels_against_brute_force(spark):
    rnd = random.Random(8)
    cs, caps = [], []
    for doc in range(1, 9):
        for page in range(1, 7):
            for k in range(rnd.randint(0, 4)):
                y = rnd.uniform(50, 700)
                cs.append((doc, rnd.choice(["IMAGE", "TABLE"]), page, k, f"{doc}.{page}.{k}", None, "p", 72.0 + rnd.choice([0.0, 30.0]), y, 300.0, y + rnd.uniform(20, 90)))
            for k in range(rnd.randint(0, 3)):  # labels come back on other pages
                caps.append((doc, page, 100 + k, doc * 1000 + page * 10 + k, 0, f"fig.{rnd.randint(1, 4)}", ["m"], 72.0 + rnd.choice([0.0, 30.0]), rnd.uniform(50, 700)))
    got = {r.content_id: r.label for r in contents.assign_labels(spark.createDataFrame(cs, CONTENT), spark.createDataFrame(caps, CAPTION)).collect()}
    assert got == labels_by_force(cs, caps) and len(set(got.values())) > 3
    none = contents.assign_labels(spark.createDataFrame(cs, CONTENT), spark.createDataFrame([], CAPTION)).collect()
    assert {r.label for r in none} == {""} and len(none) == len(cs)


def test_long_reference_list_goes_on_over_rounds(spark):
    lines = ["Body text."] * 5 + ["References"] + [x for k in range(2, 400) for x in (f"[{k}] Author {k}, a title,", "and more of it.")]
    df = blocks(spark, lines, per_page=10)
    o = layout.oriented(df, pages(spark, 81))
    got = references.references(o).collect()
    entries = [r.reference for r in sorted((r for r in got if r.reference), key=lambda r: (r.page_id, r.seq))]
    assert entries == [f"[{k}] Author {k}, a title,and more of it." for k in range(2, 400)]
    assert {r.block_id for r in got if r.block_id is not None} == set(range(6, len(lines)))


def test_headlines_are_cut_out_of_the_text(spark):
    lines = [("//Document/H1", "1. Harbours "), "Ships come in. They leave again.", ("//Document/H1", "2. Of the ferries that cross and of those that do not any more "), "More text here."]
    o = layout.oriented(blocks(spark, lines), pages(spark))
    assert {r.block_id: (r.headline, r.rest) for r in structure.headlines(o).collect()} == {0: ("1. Harbours", ""), 2: ("2. Of the ", "ferries that cross and of those that do not any more")}
    m = structure.marked_heads(o, *classify.feature_traits(o, pages(spark)))
    assert {r.block_id: r.marked for r in m.collect() if r.is_headline} == {0: "~  ", 2: "~  ferries that cross and of those that do not any more"}
    s = [r.sentence for r in paragraphs.exact_sentences(m).orderBy("section", "para_no", "sent_no").collect()]
    # the rest ends no sentence, so it goes on in what follows
    assert s == ["Ships come in.", "They leave again.", "ferries that cross and of those that do not any more More text here."]
    k = api.analyze(blocks(spark, lines), pages(spark, title="Ports"), spark.createDataFrame([], CONTENT + ", meta array<string>")).collect()
    assert not any("Harbours" in r.sentence for r in k) and "1. Harbours" in k[0].page.headlines
    assert k[0].document.title == "Ports" and k[0].document.url.endswith("/documents/1.pdf") and len({r.proposition_id for r in k}) == len(k)


def test_titles(spark):
    b = blocks(spark, [("//Document/P", "a"), ("//Document/Title", ""), ("//Document/Sect/Title", "The Title"), ("//Document/Title", "Other"), ("//Document/Title", "The Title")])
    assert layout.document_titles(b).collect() == [(1, "The Title")]
    assert {r.block_id for r in layout.without_titles(b).collect()} == {0, 1, 3}


def test_adopted_rule_keeps_its_group_conditions(spark):
    lines = [("//Document/H1", f"【目的事項】 第{k}") for k in range(3)] + [("//Document/P", "【A1】 text"), ("//Document/P", "【目的】 text")]
    o = layout.oriented(blocks(spark, lines), pages(spark, title="業務契約書"))
    heads = {r.block_id: r.is_head for r in structure.marked_heads(o, *classify.feature_traits(o, pages(spark, title="業務契約書"))).collect()}
    assert heads == {0: True, 1: True, 2: True, 3: False, 4: True}


def test_contents_lists_are_glued(spark):
    toc = "//Document/TOC/TOCI"
    lines = [(toc, "1. "), (toc, "Harbours 3"), (toc, "2. Ferries 9"), (toc, "3."), (toc, "Rivers 12"), (toc, "4. ")]
    o = layout.oriented(blocks(spark, lines, per_page=4), pages(spark, 2))
    got = structure.toc_entries(o, structure.toc_blocks(o)).orderBy("page_id", "ord").collect()
    assert [(r.page_id, r.entry) for r in got] == [(1, "1. Harbours 3"), (1, "2. Ferries 9"), (2, "3.Rivers 12")]


def test_stop_at_page_breaks(spark):
    lines = [("//Document/P[1]", "One two."), ("//Document/P[2]", "Three four"), ("//Document/Footnote[1]", "A note."), ("//Document/P[3]", "five six.")]
    o = layout.oriented(blocks(spark, lines, per_page=3), pages(spark, 2))
    m = structure.marked_heads(o, *classify.feature_traits(o, pages(spark, 2)))
    assert {r.block_id for r in structure.stopped_at_breaks(m).collect()} == {0, 1, 3}
    assert [r.sentence.split() for r in paragraphs.exact_sentences(structure.stopped_at_breaks(m)).orderBy("section", "para_no").collect()][-1] == "Three four five six.".split()


def test_ends_within_brackets_close_nothing():
    a = paragraphs.Assembler()
    got = [p for t in (" One (see a.  b.) two.  ", " Three.  ") for p in a.feed(t, 1)] + [*a.finish()]
    assert ["".join(t for t, _ in p).split() for p in got] == ["One (see a. b.) two.".split(), ["Three."]]


def test_title_counts_for_origin_and_pages_come_in_their_order(spark):
    import json

    el = lambda page, path, text, y, size: {"Page": page, "Bounds": [72, y, 500, y + 20], "Path": path, "Text": text, "TextSize": size}
    top = {
        "pages": [{"page_number": k, "width": 612, "height": 792} for k in range(2)],
        "elements": [el(1, "//Document/Title", "A long title of the whole", 700, 22), el(1, "//Document/P", "Low text.", 100, 10), el(0, "//Document/P", "First page.", 50, 10)],
    }
    b, p, _ = bundle_tables(spark.createDataFrame([(1, 1, json.dumps(top))], "bundle_id long, doc_id long, payload string"))
    assert {r.page_id: (r.page_ord, r.main_font_size) for r in p.collect()} == {2: (1, 22), 1: (2, 10)}
    assert {r.text: (r.page_ord, r.y0) for r in b.collect()} == {"Low text.": (1, 672.0), "First page.": (2, 50.0)}


def test_archive_of_bundles(spark, tmp_path):
    from pagewright.sources.bundles import archive_bundles

    rows = [(1, 7, "2024-01-01", '{"a": 1}'), (2, 7, "2024-02-01", '{"a": "é"}'), (3, 8, "2024-01-01", None), (4, 9, None, "no json")]
    df = spark.createDataFrame(rows, "bundle_id long, doc_id long, received_at string, payload string")
    for _ in range(2):
        archive_bundles(df.unionByName(df), str(tmp_path))
    got = {f.name: f.read_text(encoding="utf-8") for f in (tmp_path / "contents/documents").iterdir()}
    assert got == {"7-structuredData.json": '{"a": "é"}', "9-structuredData.json": "no json"}


def test_null_places_keep_their_rows(spark):
    b = blocks(spark, ["One two.", "Three four.", "Five."]).withColumn("page_ord", F.when(F.col("block_id") > 0, F.col("page_ord")))
    o = layout.oriented(b, pages(spark))
    assert structure.paragraph_islands(o).agg(F.sum("n_blocks")).first()[0] == 3
    m = structure.marked_heads(o, *classify.feature_traits(o, pages(spark)))
    assert paragraphs.exact_sentences(m).count() == 3


def test_tables_of_a_batch_are_removed(spark):
    from pagewright.plans import session

    before = list(session._written)
    with session.tables_of(spark):
        df = session.materialise(spark.range(5))
        assert df.count() == 5 and len(session._written) == len(before) + 1
    assert session._written == before
    path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent()
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    from pagewright.plans import session

    sc = N(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.ensure_checkpoint_dir(N(sparkContext=sc, conf=N(get=lambda k, d: d)))


def test_analysis_of_bundles(spark):
    import json

    el = lambda path, text, y, **x: {"Page": 0, "Bounds": [72, y, 500, y + 20], "Path": path, "Text": text, "TextSize": 12, **x}
    top = {
        "pages": [{"page_number": 0, "width": 612, "height": 792}],
        "elements": [
            el("//Document/P", "The ferry left. See fig. 1 for more.", 100), {"Page": 0, "Bounds": [72, 300, 200, 400], "Path": "//Document/Figure", "filePaths": ["figures/a.png"]},
        ],
    }
    df = spark.createDataFrame([(1, 1, json.dumps(top))], "bundle_id long, doc_id long, payload string")
    b, p, c = bundle_tables(df)
    assert b.count() == 1 and p.first().main_font_size == 12 and c.first().kind == "IMAGE"
    k = api.analyze_bundles(df).collect()
    assert sorted(r.sentence for r in k) == ["NO_REFERENCE_1_1", "See fig.1 for more.", "The ferry left."]
    assert next(r for r in k if r.sentence.startswith("NO"))["images"][0]["area"]["width"] == 128


def test_bundle_sentence_links_its_captioned_figure(spark):
    import json

    el = lambda path, text, y: {"Page": 0, "Bounds": [72, y, 500, y + 20], "Path": path, "Text": text, "TextSize": 12}
    fig = lambda name, y, h: {"Page": 0, "Bounds": [72, y, 200, y + h], "Path": "//Document/Figure", "filePaths": [f"figures/{name}.png"]}
    top = {
        "pages": [{"page_number": 0, "width": 612, "height": 792}],
        "elements": [el("//Document/P", "The ferry left. See fig. 1 for more.", 100), fig("a", 300, 100), el("//Document/Aside/P", "Fig. 1 The ferry.", 410), fig("logo", 5, 20), fig("line", 600, 2)],
    }
    df = spark.createDataFrame([(1, 1, json.dumps(top))], "bundle_id long, doc_id long, payload string")
    k = {r.sentence: r for r in api.analyze_bundles(df).collect()}
    image = k["See fig.1 for more."].images[0]
    assert image.surface == "fig.1" and image.area.width == 128 and image.meta == ["Fig. 1 The ferry."]
    assert not any(s.startswith("NO_REFERENCE") for s in k)  # the logo stands in the margin and the line has no shape


def test_knowledge_selects_and_labels_contents(spark):
    b = blocks(spark, ["See fig. 1 and table 2 here.", ("//Document/Caption", "Fig. 1 A ferry.")])
    cols = "doc_id long, page_id int, ord int, content_id string, kind string, label string, path string, x0 double, y0 double, x1 double, y1 double, meta array<string>"
    rows = [
        (1, 1, 5, "near", "IMAGE", None, "a", 72.0, 120.0, 200.0, 220.0, None), (1, 1, 6, "flat", "IMAGE", "", "b", 72.0, 500.0, 200.0, 600.0, None),
        (1, 1, 7, "top", "TABLE", "table 2", "c", 72.0, 5.0, 200.0, 30.0, None), (1, 1, 8, "row", "TABLE", "table 2", "d", 72.0, 400.0, 200.0, 430.0, None),
        (1, 1, 9, "full", "TABLE", "Table 2", "e", 72.0, 500.0, 200.0, 530.0, ["as delivered"]),
    ]
    cells = spark.createDataFrame([("row", 0, 0, "x"), ("full", 0, 0, "x"), ("full", 1, 0, "y")], "content_id string, row_no int, col_no int, cell_value string")
    images = spark.createDataFrame([("near", False), ("flat", True)], "content_id string, one_colour boolean")
    k = {r.sentence: r for r in api.analyze(b, pages(spark), spark.createDataFrame(rows, cols), cells=cells, images=images).collect()}
    said = next(r for s, r in k.items() if s.startswith("See"))
    assert [(i.id, i.meta) for i in said.images] == [("near", ["Fig. 1 A ferry."])] and [(t.id, t.meta) for t in said.tables] == [("full", ["as delivered"])]
    assert not any(s.startswith("NO_REFERENCE") for s in k)


def test_stream(spark, tmp_path, data):
    src = spark.read.parquet(f"{data}/bundles.parquet").where("payload is not null").select("bundle_id", "doc_id", "payload")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    stream_nodes(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(120)
    from pagewright.operators.nested import nested_nodes

    assert spark.read.parquet(str(tmp_path / "out")).count() == nested_nodes(src, dedupe=False).count() > 0


def test_empty_tables(spark):
    b, p = blocks(spark, []), pages(spark, 0)
    o = layout.oriented(b, p)
    assert structure.block_sentences(o).count() == 0 and references.references(o).count() == 0
    assert classify.document_features(o, p).count() == 0 and structure.paragraph_islands(o).count() == 0


def test_nulls_and_clashing_columns(spark):
    b = blocks(spark, ["One two.", "References", "[2] A, title."]).withColumns({c: F.lit(1) for c in ("top", "bottom", "height", "title", "margin", "lang")})
    b = b.unionByName(b.withColumns({"block_id": F.col("block_id") + 10, "path": F.lit(None).cast("string"), "font_size": F.lit(None).cast("double"), "y0": F.lit(None).cast("double")}))
    p = pages(spark).withColumn("top", F.lit(2))
    o = layout.oriented(b, p)
    assert o.count() == 6 and references.references(o).count() >= 1 and classify.document_features(o, p).count() == 1
    assert structure.block_sentences(o).count() >= 2

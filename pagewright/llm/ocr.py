"""Problem 6: noise in scanned text, by noisy-channel correction.

Lines come from scanned blocks (one row is one line) and from the Texts of scanned bundle elements (one line per
line break). Three steps, all on tables keyed by ref:

1. *Furniture.* A line at the edge of its page is a page number if its shape says so, or a running header if its
   skeleton (letters, with glyphs that are confused folded together) stands at page edges more often than inside
   pages, counted over the whole corpus.
2. *Broken words.* A fragment with a hyphen at a line's end and the first word of the next line that is no
   furniture are one word: joined, joined with its own hyphen, or not broken at all (``pre- and post-``),
   whichever form the channel and the corpus counts favour.
3. *Misread words.* The channel gives each word the words it may have been, through character confusions with their
   probabilities; corpus counts give the prior. The word as read is one of them: its prior is its count as a true
   word, that is, less the misreadings of more frequent words that it holds. Viterbi over each line's words decides,
   with counts of word pairs.

The candidates of a word are found by a form that no misreading changes: ``fold`` breaks every glyph into strokes such
that a glyph and what it is read as have the same ones (``m`` and ``rn``, ``d`` and ``cl``). Words meet the vocabulary in a
join on that form, whatever their length and however many places are misread, and an alignment of the two gives the
channel's probability.

Counts cover the whole corpus, digital texts too, and are kept as tables; only fragments of broken words are not
counted. Candidates are made once per distinct word. A reading that no neighbours could make the better one (pairs
weigh ``PAIR_WEIGHT`` at most) is left out before decoding, which changes no result. Only words that are still open
are looked up in the lines: a bit table of fixed size tells most others apart, the join that follows all of them.
Lines meet their next line in groups of a few pages, so a document that holds a third of all rows is many groups; the
last line of a group takes the first word of the next group from a table of one row per group.

Defined results: null, empty and blank texts have no row and are no next line; repeated rows count once; lines
without ord are inside their page, before its others, and lines without a page stand before all pages; a broken
word whose continuation is missing (end of document or element) has no row; words and lines of any length are handled.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators.nested import parse_payload, walk
from pagewright.operators.ordered import carry_forward, previous
from pagewright.plans.session import materialise

#: (true, read as): glyphs that scanning confuses (fixed values).
CONFUSIONS = (
    ("e", "c"), ("o", "0"), ("l", "1"), ("l", "|"), ("i", "!"), ("i", "1"), ("t", "+"), ("g", "9"), ("a", "@"),
    ("m", "rn"), ("d", "cl"), ("u", "ii"), ("h", "li"), ("n", "ri"), ("w", "vv"), ("s", "5"), ("b", "6"), ("h", "b"),
    ("B", "8"), ("S", "5"), ("O", "0"), ("I", "l"), ("I", "1"), ("I", "|"), ("E", "C"), ("G", "6"), ("Z", "2"), ("z", "2"),
    ("é", "6"), ("g", "q"), ("v", "y"), ("f", "t"), ("l", "I"), ("D", "O"), ("Q", "O"),
)
#: Probability of one confusion where its glyph occurs.
P_CONFUSED = 0.005
RARE = {("h", "b"), ("g", "q"), ("v", "y"), ("f", "t"), ("l", "I"), ("D", "O"), ("Q", "O")}
P_RARE = 0.0004
HYPHENS = "-‐‑¬­"
PAGES_PER_GROUP = 16
_EDGE = ".,;:!?()[]{}\"“”„‟«»‹›…‘‚<>*•–—/\\"
_FRAGMENT = re.compile(rf"(\S*\w)[{HYPHENS}][ \t ]*$")
_FIRST = re.compile(r"\s*(\S+)")
_LETTER = re.compile(r"[^\W\d_]")
_N = r"[0-9lIO|oSB!]{1,4}"
_NUMBER = re.compile(
    rf"(?:(?:page|seite|p[aá]gina|pag\.?|pg\.?|p\.|s\.|folio)\s*{_N}(?:\s*(?:/|of|von|sur|de)\s*{_N})?|{_N}\s*/\s*{_N}|[-–—~]\s*(?:{_N}|[ivxlc]+)\s*[-–—~]|[\[(]\s*(?:{_N}|[ivxlc]+)\s*[\])]|[ivxlc]{{1,7}})$",
    re.I,
)
_BARE = re.compile(r"[0-9lIO|o]{1,4}$")
_END_NUMBER = re.compile(rf"^\s*(?:{_N}|[ivxlc]{{1,6}})\s{{1,}}(?=\S)|(?<=\S)\s+(?:{_N}|[ivxlc]{{1,6}})\s*$", re.I)
_FOLD = (("rn", "m"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("ri", "n"), ("vv", "w"), ("e", "c"), ("0", "o"), ("1", "l"), ("|", "l"), ("i", "l"), ("!", "l"), ("+", "t"), ("9", "g"), ("@", "a"), ("5", "s"), ("6", "b"), ("8", "b"))


def is_number(text: str) -> bool:
    """Whether a whole line is a page number in one of its usual dresses, misread digits included."""
    t = text.strip()
    if not t:
        return False
    return bool(_NUMBER.match(t) or (_BARE.match(t) and (any(c.isdigit() for c in t) or not any(c in "o" for c in t))))


def skeleton(text: str) -> int:
    """Hash of a line's letters, confused glyphs folded, without a page number at either end."""
    t = _END_NUMBER.sub("", text).lower()
    for a, b in _FOLD:
        t = t.replace(a, b)
    t = "".join(c for c in t if c.isalpha())
    return int.from_bytes(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def header_shaped(text: str) -> bool:
    t = text.strip()
    return len(t) >= 3 and t[-1] not in ".,;:!?" + HYPHENS and not (t[0].islower() and not t[0].isdigit())


LINES = (
    "ref string, line int, doc_id long, page_id int, ord int, start int, text string, edge boolean, "
    "number boolean, header boolean, skel long, next_word string"
)
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in ddl.split(", "))])


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = [*zip(*rows)] if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def block_lines(blocks: DataFrame) -> DataFrame:
    """Lines of scanned blocks, marked where they are the first or last with text of their page."""
    src = blocks.where((F.col("layer") == "scan") & F.col("text").rlike(r"\S"))
    src = src.select("block_id", "doc_id", "page_id", "ord", "text")
    page = Window.partitionBy("doc_id", "page_id")
    marked = (
        src.repartition("doc_id", "page_id")
        .dropDuplicates(["doc_id", "page_id", "block_id", "ord", "text"])
        .withColumn("edge", F.coalesce((F.col("ord") == F.min("ord").over(page)) | (F.col("ord") == F.max("ord").over(page)), F.lit(False)))
    )
    schema = _schema(LINES)

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for bid, doc, page_id, o, text, edge in zip(*(c.to_pylist() for c in b.columns)):
                rows.append((f"block:{bid}", 0, doc, page_id, o, 0, text, edge, edge and is_number(text), edge and header_shaped(text), skeleton(text), None))
            yield _emit(rows, schema)

    return marked.select("block_id", "doc_id", "page_id", "ord", "text", "edge").mapInArrow(shapes, LINES)


def element_lines(bundles: DataFrame) -> DataFrame:
    """Lines of the Texts of scanned elements; edge: a one-line top element before or after a page's body."""
    schema = _schema(LINES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for bid, payload in zip(*(c.to_pylist() for c in b.columns)):
                top = parse_payload(payload)
                if top is None:
                    continue
                every = [n for n in walk(top) if n[0] == "element"]
                rim = _page_rims([n for n in every if "." not in n[1]])
                nodes = [n for n in every if n[4] and n[4].strip()]
                for n in nodes:
                    text, ref, start, at_edge = n[4], f"elem:{bid}:{n[1]}", 0, n[1] in rim
                    lines = text.split("\n")
                    for no, line in enumerate(lines):
                        after = next((x for x in lines[no + 1 :] if x.strip()), None)
                        nxt = _FIRST.match(after)[1] if after else None
                        if line.strip():
                            rows.append((ref, no, None, n[2], no, start, line, at_edge, at_edge and is_number(line), at_edge and header_shaped(line), skeleton(line), nxt))
                        start += len(line) + 1
                if len(rows) > 20_000:
                    yield _emit(rows, schema)
                    rows = []
            yield _emit(rows, schema)

    scans = bundles.where((F.col("layer") == "scan") & F.col("payload").isNotNull()).select("bundle_id", "payload")
    return scans.mapInArrow(run, LINES).dropDuplicates(["ref", "line", "start", "text"])


def _stands_alone(node: tuple) -> bool:
    text, path = (node[4] or "").strip(), node[3] or ""
    return "\n" not in text and (header_shaped(text) or is_number(text)) and not re.search(r"/(Title|Table|Figure|H\d?|L|LI|Lbl|TOCI?|Caption)(\[\d+\])?(/|$)", path)


def _page_rims(tops: list[tuple]) -> set[str]:
    """Positions of one-line top elements before the first or after the last body element of their page.

    An element without a page belongs to both pages around it where they differ.
    """
    n = len(tops)
    before, after = [-1] * n, [-1] * n
    for k in range(n):
        before[k] = tops[k][2] if tops[k][2] >= 0 else before[k - 1] if k else -1
    for k in range(n - 1, -1, -1):
        after[k] = tops[k][2] if tops[k][2] >= 0 else after[k + 1] if k + 1 < n else before[k]
    alone = [_stands_alone(t) for t in tops]
    rim: set[str] = set()
    for order, pages in ((range(n), after), (range(n - 1, -1, -1), before)):
        begun: set[int] = set()
        for k in order:
            if alone[k] and pages[k] not in begun:
                rim.add(tops[k][1])
            elif tops[k][2] >= 0 and not re.search(r"/Title(\[\d+\])?$", tops[k][3] or ""):
                begun.add(pages[k])
    return rim


def furniture(lines: DataFrame) -> DataFrame:
    """(ref) of running headers, footers and page numbers."""
    edge = lines.where("edge")
    known = (
        lines.where("skel <> 0")
        .groupBy("skel")
        .agg(F.sum(F.col("edge").cast("long")).alias("at_edge"), F.count(F.lit(1)).alias("n"))
        .where("at_edge >= 2 and at_edge * 2 > n")
        .select("skel")
    )
    headers = edge.where("header and not number").join(known, "skel", "left_semi").select("ref")
    return edge.where("number").select("ref").unionByName(headers).dropDuplicates()


def element_texts(bundles: DataFrame) -> DataFrame:
    """(text) of all elements of the bundles that were not scanned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tops = filter(None, map(parse_payload, b.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([n[4] for top in tops for n in walk(top) if n[0] == "element" and n[4]], pa.string())], names=["text"])

    other = bundles.where((F.coalesce("layer", F.lit("")) != "scan") & F.col("payload").isNotNull()).dropDuplicates(["bundle_id", "payload"])
    return other.select("payload").mapInArrow(run, "text string")


COUNTS = "a string, b string, n long, scanned boolean"
#: Distinct words and pairs that a task counts before it hands them on.
COUNTED = 400_000


def counted(texts: DataFrame) -> DataFrame:
    """(a, b, n, scanned): how often each word (b null) and each pair of neighbours stands in the texts.

    texts: (text, cont, broken, scanned); the first word of a text that is cont and the last of one that is broken are
    fragments and count for nothing, as within a text a word with a hyphen at its line's end and the one after it. Tasks
    count their own texts, so what is shuffled is distinct words and pairs. A scanned word before an exclamation mark,
    which may be a misread letter, also stands with it, and n of that row is 0.
    """
    schema = _schema(COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[bool, Counter] = {True: Counter(), False: Counter()}
        pairs: Counter = Counter()
        core: dict[str, str] = {}

        def rows() -> pa.RecordBatch:
            out = []
            for scanned, of in words.items():
                named: Counter = Counter()
                for raw, n in of.items():
                    named[core[raw]] += n
                    if scanned and (w := _shouted(raw)):
                        named[w] += 0
                out += [(w, None, n, scanned) for w, n in named.items() if w]
                of.clear()
            out += [(a, b, n, False) for (a, b), n in pairs.items() if a and b]
            pairs.clear()
            core.clear()
            return _emit(out, schema)

        for batch in batches:
            for text, cont, broken, scanned in zip(*(c.to_pylist() for c in batch.columns)):
                for line in text.split("\n"):
                    raw = line.split()
                    if cont and raw:
                        raw = raw[1:]
                    cont = bool(raw) and raw[-1][-1] in HYPHENS and len(raw[-1]) > 1
                    if raw and (cont or broken):
                        raw = raw[:-1]
                    for w in raw:
                        if w not in core:
                            core[w] = _core(w)[1]
                    words[scanned].update(raw)
                    cores = [core[w] for w in raw]
                    pairs.update(zip(cores, cores[1:]))
            if len(pairs) + len(core) > COUNTED:
                yield rows()
        yield rows()

    return texts.select("text", "cont", "broken", "scanned").mapInArrow(run, COUNTS).groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("scanned").alias("scanned"))


def _shouted(raw: str) -> str:
    """The word with the exclamation mark behind it, which may be a misread letter; empty where there is none."""
    skip, w = _core(raw)
    return w + "!" if len(w) > 1 and raw[skip + len(w) :][:1] == "!" else ""


def _strokes() -> dict[str, str]:
    """What fold makes of each glyph: one sign per class of glyphs read as each other, in place of a glyph that is read
    as two the signs of both."""
    classes: dict[str, set[str]] = {}
    for true, read in CONFUSIONS:
        if len(read) == 1:
            both = classes.get(true, {true}) | classes.get(read, {read})
            classes.update(dict.fromkeys(both, both))
    split = {true: read for true, read in CONFUSIONS if len(read) > 1}
    out: dict[str, str] = {}

    def strokes(c: str) -> str:
        alike = classes.get(c, {c})
        parts = [split[x] for x in sorted(alike) if x in split]
        assert len(parts) < 2, "glyphs that are read in two different ways would need strokes in common"
        return "".join(map(strokes, parts[0])) if parts else min(alike)

    for c in {c for pair in CONFUSIONS for glyphs in pair for c in glyphs} | set(split):
        out[c] = strokes(c)
    return out


STROKES = _strokes()


def fold(word: str) -> str:
    """The form that no misreading of the channel changes."""
    return "".join(STROKES.get(c, c) for c in word)


def folded(c):
    """The same as a column."""
    long = {g: x for g, x in STROKES.items() if len(x) > 1}
    marks = {g: chr(0xE000 + k) for k, g in enumerate(sorted(long))}  # so that no sign is replaced twice
    singles = {g: x for g, x in STROKES.items() if len(x) == 1 and x != g} | marks
    out = F.translate(c, "".join(singles), "".join(singles.values()))
    for g, mark in marks.items():
        out = F.replace(out, F.lit(mark), F.lit(long[g]))
    return out


_READ_AS: dict[str, list[tuple[str, float]]] = defaultdict(list)
for _true, _read in CONFUSIONS:
    _READ_AS[_true].append((_read, math.log(P_RARE if (_true, _read) in RARE else P_CONFUSED)))


def channel(true: str, read: str) -> float | None:
    """Log probability that a word is read as another, by the best alignment; None if the channel cannot do so."""
    at = {0: 0.0}  # what of the word as read is explained, and how well
    for c in true:
        then: dict[int, float] = {}
        for j, p in at.items():
            if read.startswith(c, j) and p > then.get(j + 1, -math.inf):
                then[j + 1] = p
            for r, lp in _READ_AS.get(c, ()):
                if read.startswith(r, j) and p + lp > then.get(j + len(r), -math.inf):
                    then[j + len(r)] = p + lp
        at = then
        if not at:
            return None
    return at.get(len(read))


def lexicon(vocabulary: DataFrame) -> DataFrame:
    """(reading, form, prior, late): the words that a text may hold, with those that differ from them in case only.

    A capitalised or upper-case word draws on the counts of the others; late ones only mend broken words.
    """
    w = F.col("word")
    cap = F.concat(F.upper(F.substring(w, 1, 1)), F.substring(F.lower(w), 2, 1 << 30))
    is_cap, is_low = (w == cap) & (w != F.lower(w)), w == F.lower(w)
    row = lambda r, share, late=False: F.struct(r.alias("reading"), (F.col("n") * share).alias("prior"), F.lit(late).alias("late"))
    forms = F.array(
        row(w, 1.0),
        F.when(is_low & (cap != w), row(cap, 0.1)),
        F.when((is_low | is_cap) & (F.length(w) > 2) & (F.upper(w) != w), row(F.upper(w), 0.05)),
        F.when(is_cap, row(F.lower(w), 0.018, True)),
    )
    words = vocabulary.where(F.col("word").rlike(r"^[\p{L}'’‐·-]*[\p{L}'’]$") & (F.col("n") > 0))
    each = words.select(F.explode(F.filter(forms, lambda x: x.isNotNull())).alias("x")).select("x.*")
    return each.groupBy("reading").agg(F.sum("prior").alias("prior"), F.min("late").alias("late")).withColumn("form", folded(F.col("reading")))


def candidates(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, reading, channel, prior, late) of all words of the lexicon that each distinct word may have been, itself among them."""
    pairs = words.withColumn("form", folded(F.col("word"))).join(lexicon(vocabulary), "form").select("word", "reading", "prior", "late")
    schema = _schema("word string, reading string, channel double, prior double, late boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for w, v, prior, late in zip(*(c.to_pylist() for c in b.columns)):
                p = 0.0 if w == v else channel(v, w)
                if p is not None:
                    rows.append((w, v, p, prior, late))
            yield _emit(rows, schema)

    return pairs.mapInArrow(run, "word string, reading string, channel double, prior double, late boolean")


#: Most that a pair of neighbours weighs, in nats: a pair seen n times weighs log(1 + n), up to this.
PAIR_WEIGHT = 3.0
#: Count of a word as a true one that it has in any case.
LEAST_COUNT = 0.02
#: How many times as many misreadings as expected a word's count may hold.
MARGIN = 3.0
#: Log prior of a word with digits or signs in it.
ODD = -60.0


def open_words(found: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, states array<struct<reading, score>>) of the words that may have been another; the word as read is a state."""
    other = found.where("not late and reading <> word and prior >= 1").withColumn("score", F.log("prior") + F.col("channel"))
    per = other.groupBy("word").agg(F.max("score").alias("best"), F.collect_list(F.struct("reading", "score")).alias("states"))
    plain = F.when(F.col("word").endswith("!"), F.expr("left(word, length(word) - 1)")).otherwise(F.col("word"))
    own = vocabulary.select(F.col("word").alias("plain"), "n")
    per = per.withColumn("plain", plain).join(own, "plain", "left")
    true = F.greatest(F.coalesce("n", F.lit(0)) - 1 - MARGIN * F.exp("best"), F.lit(LEAST_COUNT))
    own_score = F.when(F.col("plain").rlike(r"[0-9|+@!]"), F.lit(ODD)).otherwise(F.log(true))
    per = per.withColumn("own", own_score).where(F.col("best") >= F.col("own") - 2 * PAIR_WEIGHT)
    kept = F.filter("states", lambda x: x["score"] >= F.col("own") - 2 * PAIR_WEIGHT)
    return per.select("word", F.concat(kept, F.array(F.struct(F.col("word").alias("reading"), F.col("own").alias("score")))).alias("states"))


def _core(raw: str) -> tuple[int, str]:
    """Where the word begins in a run of visible characters, and the word without punctuation around it."""
    a, b = 0, len(raw)
    while a < b and raw[a] in _EDGE and raw[a] != "!":
        a += 1
    while b > a and (raw[b - 1] in _EDGE or raw[b - 1] == "’"):
        b -= 1
    return a, raw[a:b]


def wordlike(w):
    """Letters outweigh digits and signs; codes, addresses and numbers are no words."""
    letters = F.length(F.regexp_replace(w, r"[^\p{L}]", ""))
    return (letters >= 1) & (letters * 2 >= F.length(F.replace(w, F.lit("|"), F.lit("")))) & ~w.rlike(r"\d{3}|@.*\.|//")


SUSPECT = "|".join(sorted({re.escape(read) for _, read in CONFUSIONS}))
TOKENS = "ref string, line int, idx int, pos int, word string, before string, after string"
BREAKS = "ref string, line int, pos int, lhs string, rhs string"


#: Bits of the table that tells which words may be open; 2 MB, whatever the corpus.
BITS = 1 << 24


def bit_table(words: DataFrame) -> bytes:
    """A table of BITS bits with the bit of every word set: at most BITS / 32 rows reach the driver."""
    at = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(BITS))
    mask = F.expr("shiftleft(1L, cast(at % 32 as int))")
    rows = words.select(at.alias("at")).groupBy(F.expr("at div 32").alias("k")).agg(F.bit_or(mask).alias("mask")).collect()
    out = np.zeros(BITS // 32, np.uint32)
    for k, m in rows:
        out[k] = m
    return out.tobytes()


def tokens(lines: DataFrame, words: DataFrame) -> DataFrame:
    """(TOKENS) of the words among ``words``, with the words beside them. A few others may be among them."""
    schema = _schema(TOKENS)
    table = lines.sparkSession.sparkContext.broadcast(bit_table(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table.value, np.uint32)
        known: dict[str, tuple[int, str, tuple[str, ...]]] = {}

        def is_in(w: str) -> bool:
            k = zlib.crc32(w.encode("utf-8", "surrogatepass")) % BITS
            return bool(bits[k >> 5] >> (k & 31) & 1)

        def look(raw: str) -> tuple[int, str, tuple[str, ...]]:
            """(where the core begins, the core, the forms of it that are asked for) of a run of visible characters."""
            got = known.get(raw)
            if got is None:
                if len(known) > COUNTED:
                    known.clear()
                skip, w = _core(raw)
                got = known[raw] = (skip, w, tuple(x for x in (w, _shouted(raw)) if x and is_in(x)))
            return got

        for b in batches:
            rows = []
            for ref, line, start, text, broken, cont in zip(*(c.to_pylist() for c in b.columns)):
                raws = text.split()
                found = [look(raw) for raw in raws]
                last, at = len(raws) - 1, 0
                for k, (skip, _, asked) in enumerate(found):
                    at = text.index(raws[k], at)
                    if asked and not (k == 0 and cont) and not (k == last and broken):
                        before, after = (found[k - 1][1] if k else None), (found[k + 1][1] if k < last else None)
                        rows += [(ref, line, k, start + at + skip, w, before, after) for w in asked]
                    at += len(raws[k])
            yield _emit(rows, schema)

    return lines.select("ref", "line", "start", "text", "broken", "cont").mapInArrow(run, TOKENS)


def linked_lines(lines: DataFrame, dropped: DataFrame) -> DataFrame:
    """Lines without furniture, each with the first word of its next line (across pages) and whether it is broken."""
    keep = lines.where("not edge").unionByName(lines.where("edge").join(dropped, "ref", "left_anti"))
    first = F.regexp_extract("text", r"^\s*(\S+)", 1)
    group = F.coalesce(F.floor(F.col("page_id") / PAGES_PER_GROUP), F.lit(-1)).alias("grp")
    b = keep.where("doc_id is not null").select("*", group).drop("next_word")
    w = Window.partitionBy("doc_id", "grp").orderBy("ord", "ref")
    inside = b.withColumn("next_word", F.lead(first).over(w)).withColumn("before", F.lag("text").over(w))
    # One row per group of pages: what its first line begins with and its last line ends with.
    ends = b.groupBy("doc_id", "grp").agg(
        F.min("ord").alias("o"),
        F.min_by(first, F.struct("ord", "ref")).alias("head"),
        F.max_by("text", F.struct("ord", "ref")).alias("tail"),
    )
    d = Window.partitionBy("doc_id").orderBy(F.col("grp") >= 0, "o")
    ends = ends.select("doc_id", "grp", F.lead("head").over(d).alias("head"), F.lag("tail").over(d).alias("tail"))
    edge = F.col("next_word").isNull() | F.col("before").isNull()
    rim = (
        inside.where(edge)
        .join(ends, ["doc_id", "grp"])
        .withColumns({"next_word": F.coalesce("next_word", "head"), "before": F.coalesce("before", "tail")})
        .drop("head", "tail")
    )
    blocks = inside.where(~edge).unionByName(rim).drop("grp")
    e = keep.where("doc_id is null")
    elems = e.withColumn("before", F.lag("text").over(Window.partitionBy("ref").orderBy("line")))
    frag = rf"\w[{HYPHENS}][ \t ]*$"
    return (
        blocks.unionByName(elems)
        .withColumn("broken", F.coalesce(F.col("text").rlike("(?U)" + frag), F.lit(False)) & F.col("next_word").isNotNull())
        .withColumn("cont", F.coalesce(F.col("before").rlike("(?U)" + frag), F.lit(False)))
        .select("ref", "line", "doc_id", "page_id", "ord", "start", "text", "next_word", "before", "broken", "cont")
    )


def broken_words(lines: DataFrame) -> DataFrame:
    """(ref, line, pos, lhs, rhs): fragments at line ends with what may continue them."""
    schema = _schema(BREAKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for ref, line, start, text, nxt in zip(*(c.to_pylist() for c in b.columns)):
                m = _FRAGMENT.search(text)
                if not m:
                    continue
                skip, lhs = _core(m[1])
                _, rhs = _core(nxt)
                if lhs and rhs and _LETTER.search(lhs):
                    rows.append((ref, line, start + m.start(1) + skip, lhs, rhs))
            yield _emit(rows, schema)

    return lines.where("broken").select("ref", "line", "start", "text", "next_word").mapInArrow(run, BREAKS)


def broken_forms(breaks: DataFrame) -> DataFrame:
    """(lhs, rhs, form) of each distinct broken pair: joined, and joined with its own hyphen."""
    pairs = breaks.select("lhs", "rhs").dropDuplicates()
    joined, own = F.concat("lhs", "rhs"), F.concat("lhs", F.lit("-"), "rhs")
    return pairs.select("lhs", "rhs", F.explode(F.array(joined, own)).alias("form"))


def mended(forms: DataFrame, found: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(lhs, rhs, repaired) for each distinct broken pair; repaired is null where the word is not broken.

    The joined form stands without any count as a last resort; a hanging hyphen needs to be seen inside lines.
    """
    read = forms.join(found.withColumnRenamed("word", "form"), "form")
    read = read.select("lhs", "rhs", F.col("reading").alias("repaired"), (F.log("prior") + F.col("channel")).alias("score"))
    pairs = forms.select("lhs", "rhs").dropDuplicates()
    raw = pairs.select("lhs", "rhs", F.concat("lhs", "rhs").alias("repaired"), F.lit(-50.0).alias("score"))
    hang = pairs.withColumn("word", F.concat("lhs", F.lit("-"))).join(vocabulary.where("n > 0"), "word")
    hang = hang.select("lhs", "rhs", F.lit(None).cast("string").alias("repaired"), (F.log("n") + 1.0).alias("score"))
    every = read.unionByName(raw).unionByName(hang)
    return every.groupBy("lhs", "rhs").agg(F.max_by("repaired", F.struct("score", "repaired")).alias("repaired"))


def choose(hits: DataFrame, bigrams: DataFrame) -> DataFrame:
    """(ref, line, pos, reading, word): what Viterbi over each line's open words changes, with counts of word pairs.

    hits: TOKENS with states. Lines ask for just the pairs that their states and neighbours make.
    """
    token = F.struct("idx", "pos", "word", "before", "after", "states")
    lines = materialise(hits.groupBy("ref", "line").agg(F.sort_array(F.collect_list(token)).alias("open")))
    pair_schema, path_schema = _schema(ASKED), _schema(CHOSEN)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(ref, line, x, y) for ref, line, o in zip(*(c.to_pylist() for c in b.columns)) for x, y in asked_pairs(o)]
            yield _emit(rows, pair_schema)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for ref, line, o, seen in zip(*(c.to_pylist() for c in b.columns)):
                n = {(x["a"], x["b"]): x["n"] for x in seen or ()}
                rows += [(ref, line, *c) for c in viterbi(o, n)]
            yield _emit(rows, path_schema)

    seen = lines.mapInArrow(ask, ASKED).join(bigrams, ["a", "b"]).groupBy("ref", "line").agg(F.collect_list(F.struct("a", "b", "n")).alias("seen"))
    return lines.join(seen, ["ref", "line"], "left").select("ref", "line", "open", "seen").mapInArrow(decide, CHOSEN)


ASKED = "ref string, line int, a string, b string"
CHOSEN = "ref string, line int, pos int, reading string, word string"


def _runs(open_: list[dict]) -> Iterator[list[list[dict]]]:
    """Runs of neighbouring open words; each word as its tokens (one, or two where a mark behind it may be a letter)."""
    run: list[list[dict]] = []
    for t in open_:
        if run and t["idx"] == run[-1][0]["idx"]:
            run[-1].append(t)
        elif run and t["idx"] == run[-1][0]["idx"] + 1:
            run.append([t])
        else:
            if run:
                yield run
            run = [[t]]
    if run:
        yield run


def _bare(w: str) -> str:
    return w[:-1] if w.endswith("!") else w


def asked_pairs(open_: list[dict]) -> set[tuple[str, str]]:
    out: set[tuple[str, str]] = set()
    for run in _runs(open_):
        sets = [{_bare(s["reading"]) for t in ts for s in t["states"]} for ts in run]
        for left, right in zip(sets, sets[1:]):
            out |= {(x, y) for x in left for y in right}
        if run[0][0]["before"]:
            out |= {(run[0][0]["before"], y) for y in sets[0]}
        if run[-1][0]["after"]:
            out |= {(x, run[-1][0]["after"]) for x in sets[-1]}
    return out


def viterbi(open_: list[dict], n: dict[tuple[str, str], int]) -> list[tuple[int, str, str]]:
    """(pos, reading, word) of the words that the best path over a line's open words changes.

    open_: tokens with their states, in order; n: how often pairs stand in the corpus. A pair of words as read is seen
    once less, as this line is one of its places.
    """

    def weight(a: str | None, b: str | None, as_read: bool) -> float:
        return min(math.log1p(max(n.get((a, b), 0) - as_read, 0)), PAIR_WEIGHT) if a and b else 0.0

    out = []
    for run in _runs(open_):
        steps = [[(t, s["reading"], _bare(s["reading"]), s["score"], s["reading"] == t["word"]) for t in ts for s in t["states"]] for ts in run]
        before, after = run[0][0]["before"], run[-1][0]["after"]
        score = [x[3] + weight(before, x[2], x[4]) for x in steps[0]]
        back: list[list[int]] = []
        for old, new in zip(steps, steps[1:]):
            came, then = [], []
            for x in new:
                ways = [p + weight(o[2], x[2], o[4] and x[4]) for p, o in zip(score, old)]
                k = max(range(len(ways)), key=lambda i: (ways[i], old[i][4], old[i][1]))
                came.append(k)
                then.append(ways[k] + x[3])
            back.append(came)
            score = then
        end = [p + weight(x[2], after, x[4]) for p, x in zip(score, steps[-1])]
        k = max(range(len(end)), key=lambda i: (end[i], steps[-1][i][4], steps[-1][i][1]))
        for j in range(len(steps) - 1, -1, -1):
            t, reading, _, _, same = steps[j][k]
            if not same:
                out.append((t["pos"], reading, t["word"]))
            if j:
                k = back[j - 1][k]
    return out[::-1]


def continuations(lines: DataFrame) -> DataFrame:
    """(ref, line, lhs, rhs): lines that may begin with the rest of a word, with the same two fragments as its break."""
    schema = _schema("ref string, line int, lhs string, rhs string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for ref, line, before, text in zip(*(c.to_pylist() for c in b.columns)):
                m, first = _FRAGMENT.search(before), _FIRST.match(text)
                if m and first:
                    rows.append((ref, line, _core(m[1])[1], _core(first[1])[1]))
            yield _emit(rows, schema)

    ddl = "ref string, line int, lhs string, rhs string"
    return lines.where("cont").select("ref", "line", "before", "text").mapInArrow(run, ddl)


class Repairs:
    """What the steps find over one corpus; tables that several results use are written once."""

    def __init__(self, blocks: DataFrame, bundles: DataFrame):
        lines = materialise(block_lines(blocks).unionByName(element_lines(bundles)))
        self.dropped = materialise(furniture(lines))
        self.lines = materialise(linked_lines(lines, self.dropped))
        flags = lambda df, scanned: df.select("text", F.lit(False).alias("cont"), F.lit(False).alias("broken"), F.lit(scanned).alias("scanned"))
        plain = blocks.where((F.coalesce("layer", F.lit("")) != "scan") & F.col("text").isNotNull()).select("text")
        texts = self.lines.select("text", "cont", "broken", F.lit(True).alias("scanned"))
        counts = materialise(counted(texts.unionByName(flags(plain.unionByName(element_texts(bundles)), False))))
        vocabulary = counts.where(r"b is null and a rlike '\\p{L}'").select(F.col("a").alias("word"), "n", "scanned")
        breaks = materialise(broken_words(self.lines))
        forms = materialise(broken_forms(breaks))
        asked = vocabulary.where("scanned").where(F.col("word").rlike(SUSPECT)).where(wordlike(F.col("word"))).select("word")
        found = materialise(candidates(asked.unionByName(forms.select(F.col("form").alias("word"))).dropDuplicates(), vocabulary))
        self.mend = mended(forms, found, vocabulary).where("repaired is not null")
        self.hyphens = breaks.join(self.mend, ["lhs", "rhs"])
        undecided = materialise(open_words(found.join(asked, "word", "left_semi"), vocabulary))
        hits = tokens(self.lines, undecided.select("word")).join(undecided, "word")
        self.words = choose(hits, counts.where("b is not null").select("a", "b", "n"))

    def found(self) -> DataFrame:
        """(ref, noise_kind, char_pos, repaired) of every repair."""
        kind = lambda k: F.lit(k).alias("noise_kind")
        gone = self.dropped.select("ref", kind("furniture"), F.lit(0).alias("char_pos"), F.lit("").alias("repaired"))
        mended_ = self.hyphens.select("ref", kind("hyphen"), F.col("pos").alias("char_pos"), "repaired")
        read = self.words.select("ref", kind("ocr"), F.col("pos").alias("char_pos"), F.col("reading").alias("repaired"))
        return gone.unionByName(mended_).unionByName(read)

    def repaired_lines(self) -> DataFrame:
        """(ref, line, doc_id, page_id, page_ord, ord, text, was): lines with whole words, each on the line it begins."""
        edits = self.words.select("ref", "line", "pos", F.length("word").alias("size"), F.col("reading").alias("new"))
        edits = edits.unionByName(self.hyphens.select("ref", "line", "pos", F.lit(-1).alias("size"), F.col("repaired").alias("new")))
        per = edits.groupBy("ref", "line").agg(F.collect_list(F.struct("pos", "size", "new")).alias("edits"))
        tails = continuations(self.lines).join(self.mend, ["lhs", "rhs"]).select("ref", "line", F.lit(True).alias("tail"))
        fed = self.lines.join(per, ["ref", "line"], "left").join(tails.dropDuplicates(), ["ref", "line"], "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = _schema("ref string, line int, doc_id long, page_id int, ord int, text string, was string")
            for b in batches:
                rows = []
                for ref, line, doc, page, o, start, text, nxt, edits, tail in zip(*(c.to_pylist() for c in b.columns)):
                    rows.append((ref, line, doc, page, o, apply_edits(text, start, nxt, edits or [], bool(tail)), text))
                yield _emit(rows, schema)

        cols = ["ref", "line", "doc_id", "page_id", "ord", "start", "text", "next_word", "edits", "tail"]
        return fed.select(*cols).mapInArrow(run, "ref string, line int, doc_id long, page_id int, ord int, text string, was string")

    def paragraphs(self) -> DataFrame:
        """(doc_id, first_ref, n_lines, text): continuous paragraphs.

        In blocks a paragraph ends with a line that ends a sentence and is clearly shorter than its page's longest; in
        elements each Text is one. The first line of each is carried forward by groups of pages, see ``ordered``.
        """
        lines = self.repaired_lines().withColumn("page_ord", F.coalesce("page_id", F.lit(-1)))
        b = lines.where("doc_id is not null")
        widest = b.groupBy("doc_id", "page_ord").agg(F.max(F.length("was")).alias("widest"))
        b = b.join(widest, ["doc_id", "page_ord"])
        ends = F.col("was").rlike(r'[.!?。！？…][”"»」）)’]*\s*$') & (F.length("was") < F.col("widest") * SHORT_LINE)
        b = previous(b, ends, "after_end", ["page_ord", "ord", "ref"])
        begins = F.coalesce("after_end", F.lit(True))
        b = carry_forward(b, F.when(begins, F.col("ref")), "first_ref", ["page_ord", "ord", "ref"])
        e = lines.where("doc_id is null").withColumn("first_ref", F.col("ref"))
        cols = ["doc_id", "first_ref", "page_ord", "ord", "line", "text"]
        line = F.struct("page_ord", "ord", "line", "text")
        return (
            b.select(*cols)
            .unionByName(e.select(*cols))
            .groupBy("doc_id", "first_ref")
            .agg(F.sort_array(F.collect_list(line)).alias("x"))
            .select("doc_id", "first_ref", F.size("x").alias("n_lines"), F.concat_ws(" ", F.filter("x.text", lambda t: t != "")).alias("text"))
        )


#: A line that ends a sentence ends a paragraph if it is shorter than this share of its page's longest line.
SHORT_LINE = 0.6


def apply_edits(text: str, start: int, next_word: str | None, edits: list[dict], tail: bool) -> str:
    """A line with its repairs; size -1 puts a whole word in place of the fragment at the line's end."""
    for e in sorted(edits, key=lambda e: -e["pos"]):
        at = e["pos"] - start
        if e["size"] >= 0:
            text = text[:at] + e["new"] + text[at + e["size"] :]
        else:
            skip, core = _core(next_word or "")
            text = text[:at] + e["new"] + (next_word or "")[skip + len(core) :]
    if tail:
        text = _FIRST.sub("", text, count=1)
    return " ".join(text.split())

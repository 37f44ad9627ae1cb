"""Problem 3: texts longer than a limit, cut at natural boundaries into overlapping pieces.

Boundaries have levels: blank line, sentence end, clause or word, none. Within each size window the cut goes
to the deepest valley of lexical cohesion (similarity of the blocks of units left and right of the boundary,
compared by their terms) among the boundaries of the best level the window offers. Blank lines and sentence ends part
units of their own; clauses and words are too short for that, so there the blocks are a fixed number of terms on each
side. Where no valley is deeper, as in a text of one theme or without letters, the last boundary is taken. Each next
piece begins overlap_chars before the cut, so the first cut lies behind the first overlap_chars: one within them would
leave the next piece the same start and window.

cut_at of a text is the first level at which all segments, without blanks around them, are within the limit.

Defined results: null or empty texts and texts of at most max_chars give one piece and no cut_at row; a run
without any boundary is cut hard at the limit (cut_at ``none``); an overlap of the limit or more is lowered
to half of the limit, so that every piece goes forward (a null one counts as 0); a class without a limit has no rows; the pieces cover every character of the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.sentences import Chain, fitted

LEVELS = ("blank_line", "sentence", "clause_or_word", "none")
KANA_HAN = "[぀-ヿ㐀-鿿ｦ-ﾝ]"
_BREAK = r"(?:\r?\n|\r(?!\n))"
_BLANK_LINE = re.compile(rf"{_BREAK}[ \t]*{_BREAK}(?:[ \t]*{_BREAK})*")
_CLAUSE = re.compile(r"\s+|(?<=[,;:、，；：])")
#: Terms are words of two letters or more; of scripts without blanks, which hide their words, single characters.
_DENSE = "぀-ヿ㐀-鿿豈-﫿ｦ-ﾝ฀-๿"
_TERM = re.compile(rf"[{_DENSE}]|[^\W\d_{_DENSE}]{{2,}}")
WIDTH = 3  # units on each side that a boundary's cohesion compares
TERMS = 20  # terms on each side where units are too short


def _segments(text: str, cuts: list[int]) -> Iterator[str]:
    last = 0
    for c in [*cuts, len(text)]:
        yield text[last:c].strip()
        last = c


def boundaries(text: str, chain: Chain) -> dict[str, list[int]]:
    """Positions where a piece may end, by level, each list in order."""
    spans = chain.spans(text)
    return {
        "blank_line": [m.end() for m in _BLANK_LINE.finditer(text) if 0 < m.end() < len(text)],
        "sentence": [s for s, _ in spans[1:]],
        "clause_or_word": sorted({m.end() for m in _CLAUSE.finditer(text) if 0 < m.end() < len(text)}),
    }


def cut_level(text: str, at: dict[str, list[int]], max_chars: int) -> str:
    for level in LEVELS[:3]:
        if all(len(s) <= max_chars for s in _segments(text, at[level])):
            return level
    return "none"


def _terms(text: str) -> Counter:
    return Counter(m[0].lower() for m in _TERM.finditer(text))


def _similar(a: Counter, b: Counter) -> float:
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    dot = sum(v * b[k] for k, v in a.items() if k in b)
    return dot / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5


def valley_depths(text: str, cuts: list[int]) -> list[float]:
    """How deep the cohesion dips at each boundary against the peaks on both sides."""
    edges = [0, *cuts, len(text)]
    units = [_terms(text[a:b]) for a, b in zip(edges, edges[1:])]
    sims = []
    for k in range(1, len(units)):
        left, right = Counter(), Counter()
        for u in units[max(0, k - WIDTH) : k]:
            left.update(u)
        for u in units[k : k + WIDTH]:
            right.update(u)
        sims.append(_similar(left, right))
    return _depths(sims)


def _depths(sims: list[float]) -> list[float]:
    up = sims[:]  # the highest similarity reached without a descent, to the left and to the right
    for k in range(1, len(up)):
        up[k] = max(sims[k], up[k - 1]) if sims[k - 1] >= sims[k] else sims[k]
    down = sims[:]
    for k in range(len(down) - 2, -1, -1):
        down[k] = max(sims[k], down[k + 1]) if sims[k + 1] >= sims[k] else sims[k]
    return [a + b - 2 * s for a, b, s in zip(up, down, sims)]


def term_depths(text: str, cuts: list[int]) -> list[float]:
    """The same for boundaries between short units: the blocks are the TERMS terms before and behind each."""
    found = [(m.start(), m[0].lower()) for m in _TERM.finditer(text)]
    starts, terms = [a for a, _ in found], [t for _, t in found]
    sims, at, left, right = [], 0, Counter(), Counter(terms[:TERMS])
    for c in cuts:
        to = bisect_left(starts, c)
        while at < to:  # the blocks slide on by one term
            t = terms[at]
            left[t] += 1
            right[t] -= 1
            if at + TERMS < len(terms):
                right[terms[at + TERMS]] += 1
            if at >= TERMS:
                left[terms[at - TERMS]] -= 1
            at += 1
        sims.append(_similar(+left, +right))
    return _depths(sims)


def cut_text(text: str | None, max_chars: int, overlap: int, chain: Chain) -> tuple[str | None, list[tuple[int, int, str]]]:
    """(cut_at, [(start, end, level of the cut at the end)]); the last piece's level is ``end``."""
    if not text:
        return None, []
    n = len(text)
    if n <= max_chars:
        return None, [(0, n, "end")]
    at = boundaries(text, chain)
    level = cut_level(text, at, max_chars)
    overlap = max(0, min(overlap, max_chars // 2))
    depth: dict[str, list[float]] = {}
    # A first cut within the overlap would leave the next piece the same window.
    out, cut, start = [], overlap, 0
    while n - start > max_chars:
        top = start + max_chars
        for kind in LEVELS[:3]:
            a, b = bisect_right(at[kind], cut), bisect_right(at[kind], top)
            if a < b:
                break
        else:
            out.append((start, top, "none"))
            cut, start = top, top - overlap
            continue
        if kind not in depth:
            depth[kind] = (term_depths if kind == "clause_or_word" else valley_depths)(text, at[kind])
        best = max(range(a, b), key=lambda k: (depth[kind][k], at[kind][k]))
        out.append((start, at[kind][best], kind))
        cut = at[kind][best]
        start = cut - overlap
    out.append((start, n, "end"))
    return level, out


def _limited(df: DataFrame, key: str, text: str, limits: DataFrame) -> DataFrame:
    """Texts over the limit of their script, with the limit. limits has two rows (fixed): a broadcast of bounded size."""
    kind = F.when(F.col(text).rlike(KANA_HAN), "kana_han").otherwise("other")
    few = limits.where(F.col("script_class").isin("kana_han", "other")).groupBy("script_class")
    few = few.agg(F.max("max_chars").alias("max_chars"), F.max("overlap_chars").alias("overlap_chars"))
    return (
        df.select(F.col(key), F.col(text).alias("text"), kind.alias("script_class"))
        .join(F.broadcast(few), "script_class")
        .where(F.length("text") > F.col("max_chars"))
        .where("max_chars >= 1")
        .select(key, "text", "max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars"))
    )


def split_oversized(df: DataFrame, limits: DataFrame, key: str = "block_id", text: str = "text") -> DataFrame:
    """Pieces of every text over its limit: (key, cut_at, piece_no, piece_start, piece_end, cut_level)."""
    w, kind = fitted(), dict(df.dtypes)[key]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(w)
        for batch in batches:
            rows, cols = [], [[] for _ in range(5)]
            for k, (t, most, over) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                level, got = cut_text(t, most, over, chain)
                for no, (s, e, at) in enumerate(got):
                    rows.append(k)
                    for c, v in zip(cols, (level, no, s, e, at)):
                        c.append(v)
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()))]
            names = [key, "cut_at", "piece_no", "piece_start", "piece_end", "cut_level"]
            yield pa.RecordBatch.from_arrays([keys, *arrays], names=names)

    schema = f"{key} {kind}, cut_at string, piece_no int, piece_start int, piece_end int, cut_level string"
    return _limited(df, key, text, limits).mapInArrow(cut, schema)

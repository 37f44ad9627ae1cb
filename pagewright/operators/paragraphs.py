"""Paragraphs and sentences exactly, with pages, from marked blocks.

Blocks are joined until a sentence end with two blanks closes a paragraph; the rest stays for the next. As a border
between blocks after which nothing is pending makes what follows independent of what came before, a document is cut
into sections at the first such border of every few pages. Sections are spread over tasks and read as streams, block
by block: a task holds the paragraph that is not closed yet, whatever the size of the section.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import kernels as K
from pagewright.functions import text as T
from pagewright.operators.ordered import PAGES_PER_CHUNK, carry_forward, previous
from pagewright.operators.structure import INDEX_LINE
from pagewright.plans.session import materialise

_TILDE = "~  "


def sections(marked: DataFrame) -> DataFrame:
    """marked blocks with ``section``: the block that begins their section."""
    border = F.when(F.col("page_division"), F.col("page_changed")).when(F.col("long_proposition"), F.col("is_head")).otherwise(F.col("prev_closed"))
    closed = T.ends_sentence(F.col("text"), F.col("lang"))
    b = previous(marked, closed, "prev_closed", ["page_ord", "ord"])
    b = b.withColumn("border", F.coalesce(border, F.lit(True)))
    chunk = F.coalesce(F.floor(F.col("page_ord") / PAGES_PER_CHUNK), F.lit(-1))
    firsts = b.where("border").groupBy("doc_id", chunk.alias("chunk")).agg(F.min_by("block_id", F.struct("page_ord", "ord")).alias("first_border"))
    b = b.withColumn("chunk", chunk).join(firsts, ["doc_id", "chunk"], "left")
    b = carry_forward(b, F.when(F.col("block_id") == F.col("first_border"), F.col("block_id")), "section", ["page_ord", "ord"])
    return b.withColumn("section", F.coalesce("section", F.lit(-1))).drop("chunk", "first_border", "border", "prev_closed")


class Assembler:
    """Closes paragraphs as blocks arrive. A paragraph is a list of (text, page).

    The language of what is pending is kept up as blocks arrive, and only text not yet searched is searched, so the
    work is linear in the text even where nothing closes for long.
    """

    def __init__(self) -> None:
        self._hold([])

    def _hold(self, pending: list[tuple[str, int]]) -> None:
        self.pending, self.parts = pending, [t for t, _ in pending]
        self.searched, self.lang, self.length = 0, "", 0
        self.seen: set[str] = set()
        for t in self.parts:
            self._notice(t)

    def _notice(self, text: str) -> None:
        self.length += len(text)
        if text.strip():
            self.seen.add(K.language_of(text) or ("" if not text.isascii() else K.LANG_EN))
        lang = K.LANG_JA if K.LANG_JA in self.seen else K.LANG_EN if K.LANG_EN in self.seen else ""
        if lang != self.lang:
            self.lang, self.searched = lang, 0

    def feed(self, text: str, page: int) -> Iterator[list[tuple[str, int]]]:
        if self.pending and self.pending[-1][0] == _TILDE:  # a lone mark joins the block after it
            text = (_TILDE if len(self.pending) > 1 else "") + text
            self.pending.pop()
            self.parts.pop()
        self.pending.append((text, page))
        self.parts.append(text)
        self._notice(text)
        if ")" in text:  # which ends are masked may change
            self.searched = 0
        if text != _TILDE:
            yield from self._closed()

    def finish(self) -> Iterator[list[tuple[str, int]]]:
        yield from self._closed()
        if "".join(self.parts) not in ("", _TILDE):
            yield self.pending
        self._hold([])

    def _closed(self) -> Iterator[list[tuple[str, int]]]:
        while self.pending:
            ends = K.ENDS[self.lang]
            if not ends:
                return
            # Only the blocks that reach into what was not searched yet, and the two characters before.
            skip, first = 0, 0
            while first < len(self.parts) and skip + len(self.parts[first]) < self.searched - 2:
                skip += len(self.parts[first])
                first += 1
            text = "".join(self.parts[first:])
            m = re.search(f"[{re.escape(ends)}]\\s\\s", text)
            if m and "(" in text:  # an end within brackets closes nothing
                whole = "".join(self.parts) if first else text
                m = re.compile(f"[{re.escape(ends)}]\\s\\s").search(K.masked_brackets(whole, self.lang), skip)
                skip = 0
            if not m:
                self.searched = sum(map(len, self.parts))
                return
            border = skip + m.end()
            head, rest, at = [], [], 0
            for t, page in self.pending:
                cut = min(max(border - at, 0), len(t))
                if cut:
                    head.append((t[:cut], page))
                if cut < len(t):
                    rest.append((t[cut:], page))
                at += len(t)
            if rest and rest[0][0].startswith(_TILDE):
                rest[0] = (rest[0][0][len(_TILDE) :], rest[0][1])
            self._hold([(t, p) for t, p in rest if t])
            if "".join(t for t, _ in head) not in ("", _TILDE):
                yield head


def sentences_of(paragraph: list[tuple[str, int]], deep: bool = False) -> list[tuple[str, int]]:
    """(sentence, page it ends on). What is left at a paragraph's end is a sentence of its own."""
    block = "\u0002"
    text = "".join(t for t, _ in paragraph)
    lang = K.language_of(text)
    ends = K.ENDS[lang]
    joined = block.join(t for t, _ in paragraph)
    if not ends:
        return [(s, paragraph[-1][1])] if (s := K.unmasked(text).strip(" ~")) else []
    # A sentence end at a block's edge belongs before the edge.
    joined = re.sub(f"([{re.escape(ends)}]\\s+){block}", rf"{block}\1", joined)
    enc = K.masked(joined, lang)
    elements, seen = [], 0
    for part in re.split(f"([{re.escape(ends)}])\\s", enc):
        seen += part.count(block)
        piece = K.unmasked(part.replace(block, "")) if part not in ends or not part else part
        if piece:
            elements.append((piece, paragraph[min(seen, len(paragraph) - 1)][1]))
    out = []
    for s, page in K.divided_by_length(elements, lang, deep):
        s = K.without_label_spaces(re.sub(r"^~+|~+$", "", s.strip())).strip()
        if s and not (len(s) == 1 and s in ends):
            out.append((s, page))
    return out


PARAGRAPHS = "doc_id long, section long, para_no int, page_id int, total_text string, n_blocks int"
SENTENCES = "doc_id long, section long, para_no int, sent_no int, page_id int, sentence string, lang string"


def _spaced(r: dict) -> str:
    """A block's text as it is joined to the others; of a headline only the rest."""
    text = K.spaced_ends(r["text"], r["long_proposition"], r["lang"] or "")
    if r["is_headline"]:
        return (_TILDE if r["is_head"] else "") + (r["rest"] or "")
    if not r["is_head"] and r["long_proposition"]:
        return text
    if not r["is_head"] and _INDEX_LINE.match(text):
        return text.rstrip()
    text = f" {text}" if text.endswith((".", " ")) else f" {text} "
    return "~ " + text if r["is_head"] and not r["after_end"] else text


_INDEX_LINE = re.compile(INDEX_LINE.replace(r"\x{2160}-\x{217F}", "Ⅰ-ⅿ"))


class _ByPage:
    """Closes a paragraph wherever the page changes, for documents whose pages are paragraphs."""

    def __init__(self) -> None:
        self.held: list[tuple[str, int]] = []

    def feed(self, text: str, page: int) -> Iterator[list[tuple[str, int]]]:
        if self.held and self.held[-1][1] != page:
            yield self.held
            self.held = []
        self.held.append((text, page))

    def finish(self) -> Iterator[list[tuple[str, int]]]:
        if self.held:
            yield self.held
        self.held = []


_FED = ["doc_id", "section", "page_id", "page_ord", "ord", "text", "lang", "is_head", "is_headline", "rest", "after_end", "long_proposition", "page_division"]


def _streamed(marked: DataFrame, rows_of, schema: str) -> DataFrame:
    """Sections as streams; rows_of(doc, section, no, paragraph) gives the rows of each paragraph as it closes."""
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    arrow = pa.schema([(n, types[t]) for n, t in (c.split() for c in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, a, no, rows = None, None, 0, []

        def take(closed: Iterator[list[tuple[str, int]]]) -> None:
            nonlocal no
            for p in closed:
                rows.extend(rows_of(*key, no, p))
                no += 1

        def out() -> pa.RecordBatch:
            cols = [*zip(*rows)] if rows else [[]] * len(arrow)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for batch in batches:
            for r in batch.to_pylist():
                if (r["doc_id"], r["section"]) != key:
                    if key is not None:
                        take(a.finish())
                    key, no, a = (r["doc_id"], r["section"]), 0, _ByPage() if r["page_division"] else Assembler()
                if text := _spaced(r):
                    take(a.feed(text, r["page_id"]))
            yield out()
        if key is not None:
            take(a.finish())
        yield out()

    fed = sections(materialise(marked.drop("marked", "path"))).select(*_FED)
    fed = fed.repartition("doc_id", "section").sortWithinPartitions("doc_id", "section", "page_ord", "ord")
    return fed.mapInArrow(run, schema)


def paragraphs(marked: DataFrame) -> DataFrame:
    """(doc_id, section, para_no, page_id, total_text, n_blocks) of all documents."""

    def rows(doc: int, sec: int, no: int, p: list[tuple[str, int]]) -> list[tuple]:
        return [(doc, sec, no, p[0][1], K.unmasked("".join(t for t, _ in p)), len(p))]

    return _streamed(marked, rows, PARAGRAPHS)


def exact_sentences(marked: DataFrame, deep: bool = False) -> DataFrame:
    """(doc_id, section, para_no, sent_no, page_id, sentence, lang) of all documents."""

    def rows(doc: int, sec: int, no: int, p: list[tuple[str, int]]) -> list[tuple]:
        return [(doc, sec, no, n, page, s, K.language_of(s)) for n, (s, page) in enumerate(sentences_of(p, deep))]

    return _streamed(marked, rows, SENTENCES)

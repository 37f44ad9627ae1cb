"""Text functions whose steps depend on what came before, in plain Python; batches reach them through Arrow.

Sentence ends that end no sentence (after list marks and abbreviations, within brackets) are masked by one character
each, the text is cut, and the masks are turned back.
"""

from __future__ import annotations

import re
import unicodedata

from pagewright.functions.text import FULL_WIDTH, HALF_WIDTH, LABEL_WORDS, LANG_EN, LANG_JA, LANG_UNKNOWN, MAX_CHARS_JA, MAX_CHARS_OTHER, MIN_CHARS

#: Masks of sentence ends: code points that Unicode keeps for a program's own use, so that no text holds them.
MASKS = dict(zip("。.?!~", map(chr, range(0xFDD0, 0xFDD5))))
_UNMASK = {ord(mask): c for c, mask in MASKS.items()}
_ANY_MASK = re.compile("[\ufdd0-\ufdd4]")
ENDS = {LANG_JA: "。.~", LANG_EN: ".?!~", LANG_UNKNOWN: ""}
_HALF = str.maketrans(FULL_WIDTH, HALF_WIDTH)
_LABEL = re.compile(rf"(?:{LABEL_WORDS})+[.\- 　]*[0-9]+")
_JA = re.compile("[ぁ-んァ-ヴ々〇⺀-⿕㐀-䶿一-鿿豈-﫿]")
_INDEX_ALONE = re.compile(r"(?:[0-9]+|\([0-9]+\)|[0-9]+\)|[①-⑩]|[Ⅰ-ⅿ]+|[IXV]+|[ixv]+|[a-rA-R]|\([a-rA-R]\))\Z")

#: What may stand before a period that ends no sentence: list marks and abbreviations (fixed values).
ABBREVIATIONS = ("etc", "ex", "cf", "e.g", "i.e", "s.t", "et al", "et seq", "U.S", "U.S.A", "U.K", "u.s", "u.s.a", "u.k", "Fig", "FIG", "fig")
_MARKS = (r"[0-9]+", r"\([0-9]+\)", r"[①-⑩]", r"[Ⅰ-ⅿ]+", r"[IXV]+", r"[ixv]+", r"\A[a-rA-R]", r"(?<=\s)[a-rA-R]\)?", r"\([a-rA-R]\)")
_PROTECTED = re.compile("(" + "|".join((*_MARKS, *(re.escape(a).replace(r"\ ", r"\s") for a in sorted(ABBREVIATIONS, key=len, reverse=True)))) + r")\.\s(?!\s|\Z)")
_CUT = re.compile(r"\.\s(?!\s|\Z)")
#: In Japanese text: periods of decimals, addresses and before closing brackets; and every other sentence end.
_JA_ENDS = re.compile(r"(?P<inner>(?<=[a-zA-Z])\.(?=[a-zA-Z])|(?<=[0-9])\.(?=[0-9])|\.(?=[」)\]}]))|(?P<end>[。.~])\s?")
#: List marks within running text (fixed values): what stands in a pair of brackets, or between a blank and a closing
#: bracket; and marks that stand between blanks.
_BRACKETED = (r"[0-9]+", r"[\u2160-\u217F]+", r"[IXV]+", r"[ixv]+", r"[a-rA-R]")
_BETWEEN_BLANKS = r"\s[•\-①②③④⑤⑥⑦⑧⑨⑩]\s"
_LIST_MARK = re.compile("|".join([*(rf"[(\s]{m}\)" for m in _BRACKETED), _BETWEEN_BLANKS]))


def half_width(text: str) -> str:
    return text.translate(_HALF)


def nfkc(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def language_of(text: str) -> str:
    """As the Column expression: kana or Han, else Latin letters or printable ASCII, else unknown."""
    if _INDEX_ALONE.match(text):
        return LANG_UNKNOWN
    if _JA.search(text):
        return LANG_JA
    return LANG_EN if re.search("[a-zA-Z]", text) or re.fullmatch("[ -~]*", text) else LANG_UNKNOWN


def labels_of(text: str | None, is_caption: bool = False) -> list[str]:
    """Labels of figures and tables in a text. Each hit is deleted wherever it stands before the next is sought, so
    ``fig. 1`` also takes the beginning of ``fig. 12``. is_caption has no effect; it is kept for callers."""
    out: list[str] = []
    if text is None:
        return out
    while True:
        text = nfkc(half_width(text).lower())
        m = _LABEL.search(text)
        if not m:
            return out
        out.append(m[0].replace(" ", ""))
        text = text.replace(m[0], "")


def has_label(text: str | None, is_caption: bool = False) -> bool:
    """Whether a text mentions a label; null has none."""
    return text is not None and _LABEL.search(nfkc(half_width(text).lower())) is not None


def without_label_spaces(text: str) -> str:
    """``fig. 1`` as ``fig.1``; only where the label is in lower case."""
    return _LABEL.sub(lambda m: m[0].replace(" ", ""), text)


def masked_periods(text: str) -> str:
    """Periods after list marks and abbreviations masked with their blank; so are those that leave under five characters.

    Periods before two blanks, and one blank at the very end, always stand.
    """
    text = _PROTECTED.sub(lambda m: m[1] + MASKS["."], text)
    pieces = _CUT.split(text)
    out = pieces[0]
    for p in pieces[1:]:
        short = len(p) < MIN_CHARS and not _ANY_MASK.search(p) and not re.search(r"\.\s(?:\s|\Z)", p)
        out += (MASKS["."] if short else ". ") + p
    return out


def masked_brackets(text: str, lang: str) -> str:
    """Sentence ends within round brackets masked; a closing bracket without an opening one stops all masking."""
    ends = ENDS[lang]
    if not ends or not re.search(f"[{re.escape(ends)}]\\s", text):
        return text
    stack, outer = [], []
    for k, c in enumerate(text):
        if c == "(":
            stack.append(k)
        elif c == ")":
            if not stack:
                return text
            a = stack.pop()
            while outer and outer[-1][0] > a:
                outer.pop()
            outer.append((a, k))
    out, last = [], 0
    for a, b in outer:
        out.append(text[last:a])
        out.append("".join(MASKS.get(c, c) if c in ends else c for c in text[a : b + 1]))
        last = b + 1
    return "".join([*out, text[last:]])


def masked(text: str, lang: str) -> str:
    return masked_brackets(masked_periods(text), lang)


def unmasked(text: str) -> str:
    return text.translate(_UNMASK)


def spaced_ends(text: str, long_proposition: bool, lang: str) -> str:
    """One blank after a final sentence end; in Japanese after every sentence end that is no decimal point, address or
    abbreviation. Tildes of the text are masked, as the tilde marks paragraphs from here on."""
    text = text.replace("~", MASKS["~"])
    if lang == LANG_JA:
        wide = text if long_proposition else text.replace("。 ", "。  ")
        return _JA_ENDS.sub(lambda m: f"{m['end']} " if m["end"] else MASKS["."], wide)
    return f"{text} " if text.endswith((*ENDS[lang],)) else text


def cut_numbered(text: str) -> list[str]:
    """Pieces of running text, each with the list marks that lead it in and followed by a mark of a cut.

    A text without marks, or of marks alone, is one piece.
    """
    out, lead, at = [], "", 0
    hits = [m.span() for m in _LIST_MARK.finditer(text)]
    for begin, end in [*hits, (len(text), len(text))]:
        if said := text[at:begin].strip() and text[at:begin]:
            out += [lead + said, "~"]
            lead = ""
        lead, at = lead + text[begin:end], end
    return out if hits and out else [text]


def _taken(held: str, text: str, most: int, closers: frozenset[str]) -> tuple[list[str], str]:
    """(what is complete once text joins what is held, what is held then)."""
    whole = held + text
    if len(whole) <= most:
        return ([whole], "") if text in closers else ([], whole + " " * (len(text) < MIN_CHARS))
    rest = (len(whole) - 1) // most * most
    return [whole[k : k + most] + "..." for k in range(0, rest, most)], whole[rest:]


def divided_by_length(elements: list[tuple[str, int]], lang: str, deep: bool = False) -> list[tuple[str, int]]:
    """Elements (text, page) of a paragraph, texts and sentence ends in turn, as sentences of bounded length.

    Over the limit (300 in Japanese, else 2000) a text is cut into pieces with ``...``; the last piece waits for its
    sentence end. Texts under five characters are strung to what follows. What still waits at the end is a sentence.
    """
    most, closers = (MAX_CHARS_JA if lang == LANG_JA else MAX_CHARS_OTHER), frozenset(ENDS[lang])
    out, held, page = [], "", 0
    for text, page in elements:
        for part in cut_numbered(text) if deep else (text,):
            ready, held = _taken(held, part, most, closers)
            out += [(s, page) for s in ready]
    return [*out, (held, page)] if held else out

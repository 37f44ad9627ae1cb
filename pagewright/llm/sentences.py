"""Problem 2: sentence units of every text, in fourteen languages, by a linear-chain model.

Every character is tagged *boundary* (a sentence ends after it) or *inside*; decoding is Viterbi over a
linear chain. Only characters that can end a sentence at all (terminators with their closing quotes and
brackets; blanks after a letter of a script without terminators) leave both tags open. All others, and
terminators within a quotation or bracket that closes later, have one tag with certainty, so the chain is
decoded over the open positions only, which gives the same best path.

The weights are an averaged structured perceptron, fitted on the labelled sentences in ``seeds.py``: runs of
them are joined with varying blanks, and for scripts without terminators their punctuation is stripped first,
so the blanks must be learnt. Fitting takes about a second on the driver; the weights go out in the closure.

Defined results: a sentence runs from its first visible character to just after its last; null, empty and
invisible texts give no sentence; a text without any boundary is one sentence; texts of any length are decoded
whole (time and memory linear in the length).
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

from pagewright.llm.seeds import END_ABBREVIATIONS, MID_ABBREVIATIONS, NUMBER_ABBREVIATIONS, SEEDS, SPACED_ABBREVIATIONS, TITLE_ABBREVIATIONS

TERMINATORS = ".．。｡…!?！？؟۔।॥‼⁇⁈⁉"
#: Scripts whose sentences are parted by blanks alone: Thai, Lao, Khmer, Burmese blocks.
_BLANKED = "฀-໿က-႟ក-៿"
_GAP = r"\s­​-‏‪-‮⁠-⁤﻿"
_RUN = re.compile(rf"[{TERMINATORS}]+|(?<=[{_BLANKED}])[{_GAP}]+(?=[^{_GAP}])")
_PAIRED = re.compile(r"[“”„‟‘’«»\"「」『』（）()\[\]［］【】《》〈〉‹›]")
_OPEN = {"“": "”", "„": "“", "‟": "”", "‘": "’", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "［": "］", "【": "】", "《": "》", "〈": "〉", "‹": "›", "»": "«", "›": "‹", "”": "”", '"': '"'}
_CLOSE = {"”": "“„‟”", "“": "„", "’": "‘", "»": "«", "«": "»", "」": "「", "』": "『", "）": "（(", ")": "(（", "]": "[", "］": "［", "】": "【", "》": "《", "〉": "〈", "›": "‹", "‹": "›", '"': '"'}
_BRACKETS = set("）)]］】》〉")
_VISIBLE = re.compile(rf"[^{_GAP}\x00-\x1f\x7f-\x9f]")
_TOKEN_BREAK = re.compile(rf"[{_GAP}“”„«»\"「」『』（）()\[\]［］【】—–/,;:，；：、]")
_GLUED = re.compile(r"\w*(?:[^\W\d_]{4,}[.?!](?=[^\W\d_a-zß-ÿ]|\d{1,3}$)|[a-zß-ÿ]{2,}[.?!](?=[A-ZÀ-Þ][a-zß-ÿ]))")
_WORD_RUN = re.compile(r"\w*")
#: Longer than any abbreviation.
SHORT_TOKEN = 64
_LIST = re.compile(rf"\d{{1,3}}[.)][{_GAP}]+(\w)")
_SPACED = re.compile(r"(?:^|(?<=[\s(]))(?:" + "|".join(re.escape(a).replace(r"\ ", r"[\s  ]?") for a in SPACED_ABBREVIATIONS) + ")", re.I)
_KIND = {**dict.fromkeys(".．", "."), **dict.fromkeys("…", "..."), **dict.fromkeys("!?！？؟‼⁇⁈⁉", "!"), **dict.fromkeys("。｡", "cjk"), **dict.fromkeys("।॥۔", "danda")}


@lru_cache(maxsize=100_000)
def _token_class(token: str) -> str:
    low = token.lower().lstrip("'’‘-").replace("​", "")
    if not low:
        return "none"
    if low in END_ABBREVIATIONS:
        return "end"
    if low in MID_ABBREVIATIONS:
        return "mid"
    if low in TITLE_ABBREVIATIONS:
        return "title"
    if low in NUMBER_ABBREVIATIONS and (low != "no" or token[0] != "N"):
        return "num"
    if low == "no":
        return "No"
    if token.isdigit():
        return "ord" if len(token) < 3 else "year"
    if len(token) == 1:
        return "init" if token.isupper() else "single"
    if "." in token[:-1]:
        return "dotted" if all(len(x) <= 2 for x in token.split(".")) else "inner"
    if token[-1].isdigit():
        return "digits"
    return "word" if len(token) > 3 else "short"


@lru_cache(maxsize=20_000)
def _char_class(c: str) -> str:
    if c.isdigit():
        return "d"
    if c.isupper() or c.istitle():
        return "U"
    if c.islower():
        return "l"
    if c in "¿¡" or (c in _OPEN and c not in "”»›") or c in "«":
        return "O"
    if c.isalpha():
        return "C"
    cat = unicodedata.category(c)
    return "C" if cat[0] == "M" else "s" if cat[0] == "S" else "p"


def _next_class(text: str, k: int, n: int) -> str:
    """What stands at k, the first visible character after a candidate (k == n: nothing)."""
    if k >= n:
        return "end"
    c = _char_class(text[k])
    if c == "d":
        m = _LIST.match(text, k)
        return "L" if m and (m[1].isupper() or _char_class(m[1]) == "C") else "d"
    if c == "l" and k + 1 < n and text[k + 1].isupper():
        return "U"
    if c == "O":
        j = k + 1
        while j < n and (text[j] in _OPEN or text[j].isspace() or text[j] in "¿¡"):
            j += 1
        return "O" + (_char_class(text[j]) if j < n else "")
    if c == "p" and text[k] in "”’»":
        return "x"
    return c


def _pairs(text: str) -> list[tuple[int, int]]:
    """Outermost quotations and brackets that close, as (opener, closer)."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    n = len(text)
    for m in _PAIRED.finditer(text):
        c, k = m[0], m.start()
        if c in "’‘" and 0 < k < n - 1 and text[k - 1].isalpha() and text[k + 1].isalpha():
            continue
        if c in _CLOSE:
            want = _CLOSE[c]
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in want), -1)
            if at >= 0:
                opened = stack[at][1]
                del stack[at:]
                if not stack:
                    out.append((opened, k))
                continue
        if c in _OPEN:
            stack.append((c, k))
    # An opener that never closes hides nothing: what closed inside it is outermost then.
    if stack:
        cut, rest = stack[0][1], []
        for c, k in stack:
            rest.append(k)
        inner = _pairs_without(text, set(rest))
        return inner if inner is not None else [p for p in out if p[1] < cut]
    return out


def _pairs_without(text: str, skip: set[int]) -> list[tuple[int, int]] | None:
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    n = len(text)
    for m in _PAIRED.finditer(text):
        c, k = m[0], m.start()
        if k in skip or (c in "’‘" and 0 < k < n - 1 and text[k - 1].isalpha() and text[k + 1].isalpha()):
            continue
        if c in _CLOSE:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in _CLOSE[c]), -1)
            if at >= 0:
                opened = stack[at][1]
                del stack[at:]
                if not stack:
                    out.append((opened, k))
                continue
        if c in _OPEN:
            stack.append((c, k))
    return None if stack else out


def _skip(text: str, k: int, n: int) -> int:
    m = _VISIBLE.search(text, k)
    return m.start() if m else n


class _Tokens:
    """The token before each candidate of a text, asked for from left to right.

    A token reaches back to the last blank, bracket or comma, however far that is. Each character is looked at a fixed
    number of times: the class of a long token, which no abbreviation is, is kept up as it grows.
    """

    def __init__(self, text: str):
        self.text, self.seen, self.begin = text, 0, 0
        self.word_of = self.word_end = -1
        self.of = self.upto = -1

    def start(self, i: int) -> int:
        """Where the token that ends before i begins."""
        text, b = self.text, i
        while b > self.seen and not _TOKEN_BREAK.match(text[b - 1]):
            b -= 1
        if b > self.seen or not self.seen:
            self.begin = b
        self.seen, b = i, self.begin
        if self.word_of != b:
            self.word_of, self.word_end = b, _WORD_RUN.match(text, b).end()
        e = self.word_end
        if e < i and _GLUED.match(text[max(b, e - 4) : min(i, e + 6)]):
            return e + 1  # the word before ends a sentence that no blank parts from this token
        return b

    def kind(self, b: int, i: int) -> str:
        text = self.text
        if i - b <= SHORT_TOKEN:
            return _token_class(text[b:i])
        if self.of != b:
            self.of = self.upto = self.part = b
            self.digits, self.brief, self.dots = True, True, 0
        if self.digits and not text[self.upto : i].isdigit():
            self.digits = False
        while (dot := text.find(".", self.upto, i)) >= 0:
            self.brief = self.brief and dot - self.part <= 2
            self.part, self.upto, self.dots = dot + 1, dot + 1, self.dots + 1
        self.upto = i
        if self.digits:
            return "year"
        if self.dots > (text[i - 1] == "."):
            return "dotted" if self.brief and i - self.part <= 2 else "inner"
        return "digits" if text[i - 1].isdigit() else "word"


def candidates(text: str) -> list[tuple[int, int, tuple, str]]:
    """(end of the sentence if it ends here, where the next would start, signature, link) of every open position.

    link tells what joins it to the position before: the token or the quotation it closes begins just there.
    """
    out = []
    n = len(text)
    pairs = _pairs(text) if _PAIRED.search(text) else []
    p, last = 0, _skip(text, 0, n)
    spaced: list[tuple[int, int]] | None = None
    tokens = _Tokens(text)
    for m in _RUN.finditer(text):
        i, j = m.span()
        run = m[0]
        kind = _KIND.get(run[-1], "thai")
        if kind == "." and j - i > 1:
            kind = "..." if len(run) > 1 and run.strip(".") == "" else "!"
        while p < len(pairs) and pairs[p][1] < i:
            p += 1
        closer, opened, end = "", -1, j
        if p < len(pairs) and pairs[p][0] < i:
            if kind == "thai":
                continue
            to = pairs[p][1]
            if to > j and any(not (c in _CLOSE or c.isspace() or c in "​‌‍⁠﻿") for c in text[j:to]):
                continue
            if to < j:
                continue
            closer, opened, end = ("b" if text[to] in _BRACKETS else "q"), pairs[p][0], to + 1
        elif kind != "thai":
            while end < n and text[end] in "”’»)）」』]】\"" and not (pairs and p < len(pairs) and pairs[p][0] == end):
                end += 1
                closer = "u"
        k = _skip(text, end, n)
        if kind == "." and k == end and k + 1 < n and text[k].isupper() and text[k + 1] == "." and text[i - 1].isupper():
            continue  # within capitals with periods
        white = "0" if k == end else "n" if "\n" in text[end:k] else "_" if any(c.isspace() for c in text[end:k]) else "0"
        nxt = _next_class(text, k, n)
        if k < n and text[k] in TERMINATORS:
            nxt = "p"
        if kind == "thai":
            tok, start = "th" if "฀" <= text[i - 1] <= "໿" else "sea", i - 1
            if k < n and re.match(rf"[{_BLANKED}]", text[k]):
                nxt = "C"
            end = i
        else:
            b = tokens.start(i)
            tok, start = (tokens.kind(b, i) if kind == "." else "-"), b
            if kind == "." and i - b <= 3:
                if spaced is None:
                    spaced = [x.span() for x in _SPACED.finditer(text)]
                if any(x <= i < y for x, y in spaced):
                    tok = "mid"
        link = "" if kind == "thai" else "open" + closer if opened >= 0 and opened <= last else "tok" if start <= last and opened < 0 else ""
        ctx = ""
        if opened >= 0:
            q = opened - 1
            while q >= 0 and text[q].isspace():
                q -= 1
            ctx = "^" if opened <= last else ":" if q >= 0 and text[q] in ":：,，" else "m"
        if closer:
            tok = "word" if tok in ("init", "short", "title", "num", "No") else tok
        out.append((end, k, (kind, tok, white, nxt, closer, ctx), link))
        last = k
    return out


def _features(sig: tuple) -> list[str]:
    kind, tok, white, nxt, closer, ctx = sig
    head = nxt[0]
    return [
        f"k{kind}", f"kn{kind}|{head}", f"t{tok}", f"tn{tok}|{head}", f"twn{tok}|{white}|{nxt}", f"kw{kind}|{white}",
        f"kwn{kind}|{white}|{head}", f"c{closer}", f"cn{closer}|{head}", f"cx{closer}|{ctx}", f"cxn{closer}|{ctx}|{nxt}",
        f"cxwn{closer}|{ctx}|{white}|{head}",
    ]


class Chain:
    """Weights of the model: unary by signature, pairwise by (tag before, link, what the token is)."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self._unary: dict[tuple, float] = {}
        self._pair: dict[tuple, tuple[float, float]] = {}

    def unary(self, sig: tuple) -> float:
        s = self._unary.get(sig)
        if s is None:
            get = self.weights.get
            s = self._unary[sig] = sum(get(f, 0.0) for f in _features(sig))
        return s

    def pair(self, link: str, sig: tuple) -> tuple[float, float]:
        """Added to a boundary here if the position before is inside, or is a boundary."""
        key = (link, sig)
        s = self._pair.get(key)
        if s is None:
            w, names = self.weights, _links(link, sig)
            s = self._pair[key] = tuple(sum(w.get(f"{t}{f}", 0.0) for f in names) for t in "IB")
        return s

    def decode(self, text: str) -> list[tuple[int, int]]:
        """(end, next start) of every boundary, by Viterbi."""
        cands = candidates(text)
        inside, ends = -1e9, 0.0  # the text's start counts as a boundary before
        back: list[tuple[bool, bool]] = []
        for _, _, sig, link in cands:
            u = self.unary(sig)
            pi, pb = self.pair(link, sig) if link else (0.0, 0.0)
            to_b = (inside + u + pi, ends + u + pb)
            b_from = to_b[1] >= to_b[0]
            i_from = ends >= inside
            back.append((i_from, b_from))
            inside, ends = max(inside, ends), max(to_b)
        out = []
        tag = ends >= inside
        for k in range(len(cands) - 1, -1, -1):
            if tag:
                out.append((cands[k][0], cands[k][1]))
            tag = back[k][1] if tag else back[k][0]
        return out[::-1]

    def spans(self, text: str | None) -> list[tuple[int, int]]:
        """Sentences as (start, end), from the first visible character to just after the last."""
        if not text:
            return []
        n = len(text)
        start = _skip(text, 0, n)
        if start == n:
            return []
        out = []
        for end, nxt in self.decode(text):
            if end > start:
                out.append((start, end))
            start = nxt
        if start < n:
            end = n
            while end > start and not _VISIBLE.match(text[end - 1]):
                end -= 1
            out.append((start, end))
        return out


def _links(link: str, sig: tuple) -> list[str]:
    kind, tok, _, nxt, closer, _ = sig
    return [f"<{link}", f"<{link}|{tok}", f"<{link}|{tok}|{nxt[0]}"]


def _paragraphs(rounds: int, seed: int) -> Iterator[tuple[str, set[int]]]:
    """Training texts: runs of labelled sentences, with the ends of all but the last."""
    rnd = random.Random(seed)
    tongues = sorted(SEEDS)
    for _ in range(rounds):
        for lang in tongues:
            text, ends = "", set()
            for _ in range(rnd.randint(2, 6)):
                tongue = lang if rnd.random() < 0.85 else rnd.choice(tongues)
                s = rnd.choice(SEEDS[tongue])
                if tongue == "th":
                    s = re.sub(rf"[{TERMINATORS}]+$", "", s)  # stripped of punctuation: only blanks remain
                if text:
                    ends.add(len(text))
                    tight = tongue in ("ja", "zh") and lang in ("ja", "zh") and rnd.random() < 0.8
                    text += "" if tight else rnd.choice([" ", " ", " ", " ", " ", "  ", "\n", " \n", "\n\n"])
                    if not tight and rnd.random() < 0.03 and text[-1] == " " and re.search(r"[a-z][.!?] $", text) and s[:1].isupper():
                        text = text.rstrip()
                text += s
            yield text, ends


@lru_cache(maxsize=1)
def fitted(rounds: int = 70, epochs: int = 12, seed: int = 7) -> dict[str, float]:
    """Averaged structured perceptron over the seed sentences."""
    data = []
    for text, ends in _paragraphs(rounds, seed):
        cands = candidates(text)
        data.append((text, cands, [c[0] in ends or c[1] >= len(text) for c in cands]))
    w: dict[str, float] = defaultdict(float)
    total: dict[str, float] = defaultdict(float)
    step = 1

    def add(tags: list[bool], cands: list, sign: float) -> None:
        before = "B"
        for tag, (_, _, sig, link) in zip(tags, cands):
            if tag:
                for f in _features(sig) + ([f"{before}{x}" for x in _links(link, sig)] if link else []):
                    w[f] += sign
                    total[f] += sign * step
            before = "B" if tag else "I"

    for _ in range(epochs):
        wrong = 0
        for text, cands, gold in data:
            step += 1
            got = {e for e, _ in Chain(w).decode(text)}
            tags = [c[0] in got for c in cands]
            if tags != gold:
                wrong += 1
                add(gold, cands, 1.0)
                add(tags, cands, -1.0)
        if not wrong:
            break
    return {f: v - total[f] / step for f, v in w.items() if v - total[f] / step}


def split_sentences(df, key: str = "block_id", text: str = "text", weights: dict[str, float] | None = None):
    """(key, sent_start, sent_end) of every sentence; a projection in Arrow batches, no shuffle."""
    import pyarrow as pa

    w = weights or fitted()
    kind = dict(df.dtypes)[key]

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(w)
        for batch in batches:
            rows, starts, ends = [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                for s, e in chain.spans(t):
                    rows.append(k)
                    starts.append(s)
                    ends.append(e)
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[key, "sent_start", "sent_end"]
            )

    return df.select(key, text).mapInArrow(spans, f"{key} {kind}, sent_start int, sent_end int")

"""Problem 9: subject areas of each post, by one-versus-rest linear classifiers on hashed word n-grams.

Only a post's own words count: quotations (tags with nesting, ``>`` lines, forwarded messages), signatures,
markup, code and deletion notices are removed first. The rest is cut into sentences; each gets a probability per
subject. A post has the subjects of its sentences above the calibrated threshold of each subject; a sentence that
names a subject only behind a comparison (``slower than the ...``) names it in passing and does not count.

Training: the labelled examples show part of each vocabulary, so posts of a bounded, hashed sample of whole sections
are labelled weakly, first by where they stand. The section of a post is the thread it stands in, within its source;
what a first model sees in all posts of a section together is the section's label, and each of its posts takes it
unless its own words clearly say otherwise. A post that gives a web address and speaks for no subject is spam. Posts of
sections without a label count where their own words are clear. These weak labels and the examples train the final
model. Thresholds are calibrated for each subject on held-out sentences.

Defined results: posts without words of their own have no row; posts whose words fit no subject are ``general``;
spam is ``advert`` alone; whole texts are read, whatever their length; repeated rows give repeated rows, which the
queries drop. Without labelled examples there is no subject to give, and no row.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 19
#: Bound of the unlabelled training sample, in posts.
SAMPLE_POSTS = 6000
#: Bound of what one section gives to it; far above the size of a thread.
SECTION_POSTS = 200
GENERAL, ADVERT = "general", "advert"

_TAG = re.compile(r"\[(/?)quote\b[^\]\n]*\]|<(/?)blockquote\b[^>\n]*>", re.I)
_FORWARD = re.compile(r"^[ \t>]*-{3,}\s*(?:Original Message|Ursprüngliche Nachricht|Message d.origine|Mensaje original|元のメッセージ|Forwarded message)\s*-{3,}.*\Z", re.I | re.M | re.S)
_QUOTED = re.compile(r"^[ \t]*(?:>|&gt;|\|\s).*$", re.M)
_LEAD = re.compile(r"(?:\b(?:wrote|schrieb|escribió|a écrit|said)|さんは?書きました|さんの投稿)\s?:[ \t]*$", re.I | re.M)
_LEAD_NAME = re.compile(r"^[ \t]*[\w.-]{2,40}\s(?:wrote|schrieb|escribió|a écrit)\s?:[ \t]*", re.I | re.M)
_CODE = re.compile(r"\[code\].*?(?:\[/code\]|\Z)|<(pre|code)\b.*?(?:</\1>|\Z)", re.I | re.S)
_SIGNATURES = (
    re.compile(r"(?:\A|\n)[ \t]*(?:--|—|_{6,})[ \t]*\r?\n.*\Z", re.S),
    re.compile(r"<hr\s*/?>\s*<small>.*?(?:</small>|\Z)", re.I | re.S),
    re.compile(r"\[size=\d\]\s*\[i\].*?(?:\[/i\]\s*\[/size\]|\Z)", re.I | re.S),
    re.compile(r"^[ \t]*\*{3,}[^\n]*\*{3,}[ \t]*$", re.M),
    re.compile(r"^[ \t]*[a-z]+_[a-z]+\d*[ \t]*(?:[|,·][^\n]*)?$", re.M),
    re.compile(r"^[ \t]*(?:Sent from my|Gesendet von mein|Envoyé de mon|Enviado desde mi)\b[^\n]*$", re.I | re.M),
)
_DELETED = re.compile(
    r"^\W*(?:\[?\(?(?:deleted|removed|gelöscht|supprimé|eliminado|borrado|削除済み)\)?\]?|post deleted by author|this post was (?:removed|deleted)[^.\n]*|beitrag gelöscht[^.\n]*|message supprimé[^.\n]*|mensaje eliminado[^.\n]*|(?:この)?投稿は削除されました)\W*$",
    re.I | re.M,
)
_URL = re.compile(r"\[url=[^\]\n]*\].*?\[/url\]|https?://\S+", re.I)
_MARK = re.compile(r"</?[a-zA-Z][^>\n]{0,200}>|\[/?(?:b|i|u|s|size|color|url|img|list|quote|spoiler|\*)\b[^\]\n]*\]|:[a-z_]{2,20}:", re.I)
_SENTENCE = re.compile(r"(?<=[.!?。！？])(?=\s|[^\x00-\x7f])|\n+|(?<=[。！？])")
_KANA = "぀-ヿ㐀-鿿々ー"
#: Generic top-level domains, and the names that RFC 2606 keeps for documentation and tests (fixed values).
_TLD = "com|net|org|edu|gov|info|biz|name|pro|shop|store|online|site|club|xyz|top|live|app|dev|example|test|invalid|localhost"
_TOKEN = re.compile(rf"[\w-]+\.(?:{_TLD})\b|[{_KANA}]+|[^\W\d_{_KANA}]+(?:['’][^\W\d_{_KANA}]+)*|\d+|[%!>]+")
_DIGIT = re.compile(r"\d")
_LEET = re.compile(r"(?<![\w])(?=\w*[a-z])\w*(?:[a-z][0134579@$]|[0134579@$][a-z])[\w.@$]*")
_UNLEET = str.maketrans("0134579@$", "oieastgas")
_ADDRESS = re.compile(rf"\w\.(?:{_TLD})\b", re.I)
_DOMAIN = re.compile(rf"\.(?:{_TLD})$")
_LETTER = re.compile(r"[^\W\d_]")
#: Words that introduce what something is compared with (fixed values).
_THAN = re.compile(r"\b(?:than|like|als|wie|que|qu['’]|como|comme)\b", re.I)
_THAN_JA = re.compile(r"より|みたい|のよう|ほど")
WINDOW = 14


def _cut_tags(text: str) -> str:
    """Without quotations in tags; nested ones go with the outermost. A tag that never closes quotes to the end."""
    out, depth, last, opened = [], 0, 0, 0
    for m in _TAG.finditer(text):
        closing = bool(m[1] or m[2])
        if not closing:
            if depth == 0:
                opened = m.start()
                out.append(text[last : m.start()])
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                last = m.end()
                out.append("\n")
    if depth:
        line = text[text.rfind("\n", 0, opened) + 1 : opened]
        return "".join(out) + (text[opened:] if line.lstrip().startswith(">") else "")
    return "".join([*out, text[last:]])


def _cut_leads(text: str) -> str:
    """Without the lines that lead in a quotation, such as ``... wrote:``; a long line that ends so is no such line."""
    out, last = [], 0
    for m in _LEAD.finditer(text):
        begin = text.rfind("\n", 0, m.start()) + 1
        if m.start() - begin <= LEAD_CHARS:
            out.append(text[last:begin])
            last = m.end()
    return "".join([*out, text[last:]]) if out else text


#: A line that leads in a quotation has at most so many characters before its verb.
LEAD_CHARS = 120


def own_words(text: str | None) -> str:
    """The author's own words of a post."""
    if not text:
        return ""
    t = text.replace("\r\n", "\n").replace("\r", "\n")
    t = _cut_tags(t)
    t = _FORWARD.sub("", t)
    t = _cut_leads(_QUOTED.sub("", _LEAD_NAME.sub("", t)))
    t = _CODE.sub("\n", t)
    for s in _SIGNATURES:
        t = s.sub("\n", t)
    t = _MARK.sub(" ", _URL.sub(" ", re.sub(r"<(?:br|p|div|/p|/div)\b[^>]*>", "\n", t, flags=re.I)))
    t = html.unescape(t).replace("\xa0", " ")
    return _DELETED.sub("", t)


def sentences_of(text: str) -> list[str]:
    """Sentences with letters; long unpunctuated ones in windows of a few words."""
    out = []
    for s in _SENTENCE.split(text):
        if not s or not _LETTER.search(s):
            continue
        words = s.split()
        if len(words) > 2 * WINDOW:
            out += [" ".join(words[k : k + WINDOW]) for k in range(0, len(words), WINDOW)]
        else:
            out.append(s.strip())
    return out


def _plain(text: str) -> str:
    """In lower case, with digits and signs that stand for letters as letters."""
    low = text.lower().replace("’", "'")
    return _LEET.sub(lambda m: m[0].translate(_UNLEET), low) if _DIGIT.search(low) else low


def gives_address(text: str) -> bool:
    return _ADDRESS.search(_plain(text)) is not None


def _hash(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass"))


class Grams:
    """Hashed one- and two-word grams of many texts at once; of Japanese and Chinese, character grams of two to four.

    Each distinct word is hashed once and kept, up to KEPT words; two-word grams are mixed from the hashes of their
    words, for all texts in one step.
    """

    KEPT = 300_000
    BREAK = -1

    def __init__(self) -> None:
        self.of: dict[str, int | tuple[int, ...]] = {}

    def _word(self, w: str) -> int | tuple[int, ...]:
        if len(self.of) >= self.KEPT:
            self.of.clear()
        if "぀" <= w[0] <= "ヿ" or "㐀" <= w[0] <= "鿿" or w[0] == "々":
            got = tuple(_hash(w[k : k + n]) for n in (2, 3, 4) for k in range(len(w) - n + 1)) or (_hash(w),)
        else:
            got = _hash("0" if w.isdigit() else ".domain" if _DOMAIN.search(w) else w)
        self.of[w] = got
        return got

    def bags(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each once per text; how many ids each text has)."""
        get, word, find = self.of.get, self._word, _TOKEN.findall
        seq: list[int] = []
        ends = np.empty(len(texts), np.int64)
        dense: list[int] = []
        owner: list[int] = []
        for k, t in enumerate(texts):
            for w in find(_plain(t)):
                h = get(w)
                if h is None:
                    h = word(w)
                if type(h) is int:
                    seq.append(h)
                else:
                    dense.extend(h)
                    owner.extend([k] * len(h))
                    seq.append(self.BREAK)
            seq.append(self.BREAK)
            ends[k] = len(seq)
        h = np.array(seq, np.int64)
        of = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        one = h != self.BREAK
        two = one[1:] & one[:-1]
        mixed = ((h[:-1] * 1_000_003) ^ (h[1:] * 2_654_435_761)) >> 7
        ids = np.concatenate([h[one], mixed[two], np.array(dense, np.int64)]) % BUCKETS
        text = np.concatenate([of[one], of[1:][two], np.array(owner, np.int64)])
        key = np.sort(text * BUCKETS + ids)
        key = key[np.diff(key, prepend=-1) > 0]
        return key % BUCKETS, np.bincount(key // BUCKETS, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)

    def split(self, texts: list[str]) -> list[np.ndarray]:
        flat, size = self.bags(texts)
        return np.split(flat, np.cumsum(size)[:-1]) if len(texts) else []


def without_comparison(sentence: str) -> tuple[str, str]:
    """(what is said, what it is compared with); the second is empty where there is no comparison."""
    m = None
    for m in _THAN.finditer(sentence):  # the last one: "dit que ... plus que ..." compares with what follows it
        pass
    if m and m.start() > 3:
        return sentence[: m.start()], sentence[m.end() :]
    m = _THAN_JA.search(sentence)
    if m:
        head, tail = sentence[: m.start()], sentence[m.end() :]
        k = max(head.rfind(c) for c in "は、")
        return (head[: k + 1] + tail, head[k + 1 :]) if k >= 0 else (tail, head)
    return sentence, ""


class Subjects:
    """One logistic model per subject over hashed n-grams; thresholds per subject."""

    def __init__(self, names: list[str], w: np.ndarray, b: np.ndarray, cut: np.ndarray):
        self.names, self.w, self.b, self.cut, self.grams = names, w, b, cut, Grams()

    def probs(self, texts: list[str]) -> np.ndarray:
        """Probability of each subject per text; each distinct text is looked at once."""
        place: dict[str, int] = {}
        at = [place.setdefault(t, len(place)) for t in texts]
        return self.probs_of(*self.grams.bags([*place]))[at] if texts else np.zeros((0, len(self.names)))

    def probs_of(self, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        z = np.tile(self.b, (len(size), 1)).astype(np.float64)
        full = size > 0
        if full.any():
            at = np.concatenate([[0], np.cumsum(size[full])[:-1]])
            z[full] += np.add.reduceat(self.w[flat], at, axis=0) / np.sqrt(size[full])[:, None]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def of_posts(self, posts: list[str]) -> list[list[str]]:
        """Subjects of each post's own words; an empty list where it has none."""
        flat, owner = [], []
        for k, t in enumerate(posts):
            for s in sentences_of(t):
                said, other = without_comparison(s)
                flat += [s, said] if other else [s, None]
                owner.append(k)
        asked = [s or "" for s in flat]
        p = self.probs(asked) if asked else np.zeros((0, len(self.names)))
        whole, said = p[0::2], p[1::2]
        compared = np.array([x is not None for x in flat[1::2]], bool)
        # A subject named only behind the comparison is named in passing.
        hit = np.where(compared[:, None], np.minimum(whole, said), whole) >= self.cut
        hit &= whole >= 0.5 * whole.max(1, initial=0.0)[:, None]
        top = whole.argmax(1) if len(whole) else np.zeros(0, int)
        out: list[list[str]] = [[] for _ in posts]
        n_sent, votes, ads = Counter(owner), defaultdict(Counter), Counter()
        advert = self.names.index(ADVERT) if ADVERT in self.names else -1
        for k, j in zip(*(x.tolist() for x in np.nonzero(hit))):
            votes[owner[k]][self.names[j]] += 1
        if advert >= 0:
            ads.update(owner[k] for k in np.flatnonzero(hit[:, advert] & (top == advert)).tolist())
        for k in n_sent:
            got = votes[k]
            if ads[k] * 2 >= n_sent[k]:
                out[k] = [ADVERT]
                continue
            real = sorted(s for s in got if s not in (GENERAL, ADVERT))
            out[k] = real or [GENERAL]
        return out


def _fit(bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, classes: int, epochs: int, seed: int = 3, rate: float = 0.6, l2: float = 1e-5):
    rnd = np.random.default_rng(seed)
    w, b = np.zeros((BUCKETS, classes), np.float32), np.full(classes, -2.0, np.float32)
    gw = np.full(BUCKETS, 1e-2, np.float32)
    size = np.array([len(x) for x in bags])
    flat, start = np.concatenate(bags), np.concatenate([[0], np.cumsum(size)])
    for e in range(epochs):
        order = rnd.permutation(np.flatnonzero(size))
        lr = rate * (1 - e / epochs)
        for k in range(0, len(order), 128):
            rows = order[k : k + 128]
            n = size[rows]
            ids = np.concatenate([flat[start[r] : start[r + 1]] for r in rows])
            at = np.concatenate([[0], np.cumsum(n)[:-1]])
            scale = (1 / np.sqrt(n)).astype(np.float32)
            z = np.add.reduceat(w[ids], at, axis=0) * scale[:, None] + b
            d = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            d[np.arange(len(rows)), y[rows]] -= 1
            d *= weight[rows][:, None]
            b -= lr * 0.2 * d.mean(0)
            by = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.diff(ids[by], prepend=-1))
            uniq = ids[by][first]
            g = np.add.reduceat(np.repeat(d * scale[:, None], n, axis=0).astype(np.float32)[by], first, axis=0)
            gw[uniq] += (g * g).mean(1)
            w[uniq] -= lr * (g / np.sqrt(gw[uniq])[:, None] + l2 * w[uniq])
    return w, b


def _calibrated(model: Subjects, texts: list[str], y: np.ndarray) -> np.ndarray:
    """Per subject the threshold of best F1 on held-out sentences, between 0.5 and 0.8; false hits weigh more."""
    p = model.probs(texts)
    cut = np.full(len(model.names), 0.5)
    for j in range(len(model.names)):
        best = 0.0
        for c in np.arange(0.5, 0.81, 0.05):
            hit = p[:, j] >= c
            tp, fp, fn = (hit & (y == j)).sum(), (hit & (y != j)).sum(), (~hit & (y == j)).sum()
            f = tp / max(tp + 0.75 * fp + 0.25 * fn, 1)
            if f > best + 1e-9:
                best, cut[j] = f, c
    return cut


def train(examples: list[tuple[str, str]], sample: list[tuple[str, str]]) -> Subjects:
    """examples: (subject, text); sample: (section, own words) of unlabelled posts."""
    names = sorted({s for s, _ in examples})
    code = {s: k for k, s in enumerate(names)}
    base, base_y = [], []
    for s, t in examples:
        for x in sentences_of(own_words(t)):
            base.append(without_comparison(x)[0])
            base_y.append(code[s])
    grams = Grams()
    base_bags = grams.split(base)
    model = Subjects(names, *_fit(base_bags, np.array(base_y), np.ones(len(base)), len(names), 12), np.full(len(names), 0.5))
    posts = [(sec, [without_comparison(x)[0] for x in xs]) for sec, t in sample if (xs := sentences_of(t))]
    words = np.array([sum(len(x.split()) + len(x) // 12 for x in xs) for _, xs in posts])
    address = np.array([any(map(gives_address, xs)) for _, xs in posts], bool)
    flat = [x for _, xs in posts for x in xs]
    owner = np.repeat(np.arange(len(posts)), [len(xs) for _, xs in posts])
    flat_bags = grams.split(flat)
    section_of = {sec: k for k, sec in enumerate(dict.fromkeys(sec for sec, _ in posts))}
    sections = np.array([section_of[sec] for sec, _ in posts], int)
    for round_ in range(3):
        if not flat:
            break
        p = model.probs_of(np.concatenate(flat_bags), np.array([len(x) for x in flat_bags]))
        # Evidence of a post: how far its sentences speak for each subject, beyond chance.
        ev = np.zeros((len(posts), len(names)))
        np.add.at(ev, owner, np.where(p > 0.35, p, 0.0))
        if GENERAL in code:
            ev[:, code[GENERAL]] *= 0.5
        best, top = ev.argmax(1), ev.max(1)
        clear = (top > 0.6) & (top > 2.0 * np.partition(ev, -2, 1)[:, -2])
        # Evidence of a section: its clear posts' subjects; a label if two or more agree and few do not.
        votes = np.zeros((len(section_of), len(names)))
        np.add.at(votes, (sections[clear], best[clear]), 1)
        leads = votes.max(1)
        of_section = np.where((leads >= 2) & (leads * 4 >= 3 * votes.sum(1)), votes.argmax(1), -1)[sections]
        # The section's label comes first; a post's own clear words, or a web address in a post of no subject, overrule it.
        label = np.where((words >= 12) & ~address, of_section, -1)
        label = np.where(clear, best, label)
        if ADVERT in code:
            label[address & ~clear & (top <= 0.6)] = code[ADVERT]
        if GENERAL in code:  # a few words that speak for nothing are small talk
            label[((top <= 0.3) & (words < 12) | (top <= 0.8) & (words < 4)) & ~address] = code[GENERAL]
        # Sentences that agree with their post, or have no view, take its label; those that name another do not.
        lab = label[owner]
        own = p[np.arange(len(flat)), np.maximum(lab, 0)]
        rival = p.max(1)
        use = np.flatnonzero((lab >= 0) & ((rival < 0.5) | (own >= rival - 1e-9)))
        # Each distinct sentence once per label: reposts and stock phrases do not outvote the rest.
        use = np.array([*{(flat[k], lab[k]): k for k in use}.values()], int) if len(use) else use
        texts_y = np.concatenate([base_y, lab[use]]).astype(int)
        counts = np.bincount(texts_y, minlength=len(names))
        w = np.concatenate([np.full(len(base), 2.0), np.full(len(use), 1.0)])
        w *= np.minimum((len(texts_y) / len(names) / np.maximum(counts, 1)) ** 0.5, 3.0)[texts_y]
        bags = base_bags + [flat_bags[k] for k in use]
        held = np.arange(len(bags)) % 8 == 7
        fit = np.flatnonzero(~held)
        model = Subjects(names, *_fit([bags[k] for k in fit], texts_y[fit], w[fit], len(names), 5 + round_), np.full(len(names), 0.5))
        if round_ == 2:
            texts = base + [flat[k] for k in use]
            test = np.flatnonzero(held)
            model.cut = _calibrated(model, [texts[k] for k in test], texts_y[test])
    return model


def sampled_posts(documents: DataFrame, most: int) -> list[tuple[str, str]]:
    """About ``most`` posts of whole sections, at most twice as many; (section, own words).

    Sections are chosen by hash, so each chosen one has all its posts whatever the size of the corpus. Posts without a
    thread are chosen singly. Where a few sections hold most posts, a chosen one gives ``SECTION_POSTS`` at most, and
    posts chosen singly fill up a sample that is less than half full.
    """
    n = documents.count()
    section = F.when(F.col("thread_id").isNotNull(), F.concat_ws("/", "source", F.col("thread_id").cast("string")))
    share = int((1 << 30) * min(1.0, most / max(n, 1)))
    among = lambda h: F.pmod(h, F.lit(1 << 30)) < share
    posts = documents.where("text is not null").select(section.alias("section"), "text", "doc_id", F.xxhash64("doc_id").alias("single"))
    posts = posts.withColumn("h", F.when(F.col("section").isNull(), F.col("single")).otherwise(F.xxhash64("section")))
    place = F.row_number().over(Window.partitionBy("section", "h").orderBy("single", "doc_id"))
    whole = posts.where(among(F.col("h"))).dropDuplicates().withColumn("place", place)
    if n > most:
        whole = whole.where(F.col("place") <= SECTION_POSTS)
    rows = whole.orderBy("h", "section", "place").limit(2 * most).select("section", "text", "doc_id").collect()
    if n > most and 2 * len(rows) < most:
        rows += posts.where(among(F.col("single"))).dropDuplicates().orderBy("single", "doc_id").limit(most).select("section", "text", "doc_id").collect()
        rows = list(dict.fromkeys(rows))
    rows = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"]))
    return [(r["section"] or f"#{r['doc_id']}", own_words(r["text"])) for r in rows]


def subjects_of(documents: DataFrame, examples: DataFrame, most: int = SAMPLE_POSTS, max_examples: int = 20_000) -> DataFrame:
    """(doc_id, subject): one row per subject of each post. No shuffle: the model of fixed size is broadcast."""
    labelled = [(r[0], r[1]) for r in examples.where("text is not null and subject is not null").select("subject", "text").limit(max_examples).collect()]
    if not any(own_words(t) for _, t in labelled):
        return documents.sparkSession.createDataFrame([], "doc_id long, subject string")
    model = train(sorted(labelled), sampled_posts(documents, most))
    sent = documents.sparkSession.sparkContext.broadcast((model.names, model.w.astype(np.float16), model.b, model.cut))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, w, b, cut = sent.value
        m = Subjects(names, w.astype(np.float32), b, cut)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows, subject = [], []
                for i, got in enumerate(m.of_posts([own_words(t) for t in part.column(1).to_pylist()])):
                    for s in got:
                        rows.append(i)
                        subject.append(s)
                keys = part.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(subject, pa.string())], names=["doc_id", "subject"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, subject string")

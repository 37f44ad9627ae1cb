"""Problem 4: the language of every text and of every segment of a mixed text, with a confidence.

Model: hashed subwords (character 1- to 4-grams of words with edge marks), each with an embedding; a sentence is
the average of its subwords' embeddings; a linear softmax gives the language. Trained by stochastic gradient
descent in numpy on a bounded sample of labelled texts plus the labelled sentences of ``seeds.py``: delivered
labels are partly wrong, so the seeds' model first drops labels it is sure are wrong, and the next model those it
disagrees with, before the last fit.
A temperature and a rejection level are calibrated on held-out sentences: sentences below the level take the
language of their neighbours.

For decoding, embedding times softmax weights is one table of a score vector per subword, so a sentence costs a
sum over its words, each looked up in a cache per distinct word. A mixed text is decoded by Viterbi over its
sentences, with a penalty for each change of language.

Defined results: null, empty and letterless texts have no row (no language is claimed); repeated rows count once;
long texts are decoded whole; a text of one language has one segment from 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.normalise import visible_form
from pagewright.llm.seeds import SEEDS
from pagewright.llm.sentences import Chain, fitted

LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "ru", "ja", "zh", "ko", "ar", "hi", "th")
BUCKETS, DIM, MAX_GRAM = 1 << 15, 24, 4
#: Bounds of the training sample: about this many labelled texts per language, at most twice as many in all, of at most
#: so many characters, each of which gives so many of its sentences, chosen by hash from the whole text.
SAMPLE_PER_LANGUAGE, SAMPLE_CHARS, SAMPLE_SENTENCES = 250, 20_000, 6
#: A label is dropped at first only where the seeds speak for another language with more than this.
DOUBT = 0.8
#: Small samples are seen often enough for this many steps.
LEAST_STEPS = 250
SWITCH = 4.0  # cost of a change of language between sentences, in nats
_DENSE = "぀-ヿ㐀-鿿฀-໿豈-﫿"
#: Letters beside digits are codes, not words.
_WORD = re.compile(rf"[{_DENSE}]+|(?<![\d_])(?<![^\W_{_DENSE}])[^\W\d_{_DENSE}]++(?![^\W{_DENSE}])")
_DENSE_RE = re.compile(f"[{_DENSE}]")


def words_of(text: str) -> list[str]:
    """Words in lower case; runs of scripts without blanks become overlapping pairs of characters."""
    out = []
    for w in _WORD.findall(visible_form(text).lower()):
        if _DENSE_RE.match(w) and len(w) > 2:
            out += [w[k : k + 2] for k in range(len(w) - 1)]
        else:
            out.append(w)
    return out


def subwords(word: str) -> tuple[int, ...]:
    return _subwords(word) if len(word) <= KEPT_CHARS else _subwords.__wrapped__(word)


@lru_cache(maxsize=200_000)
def _subwords(word: str) -> tuple[int, ...]:
    w = f"<{word}>"
    return tuple(
        zlib.crc32(w[k : k + n].encode("utf-8", "surrogatepass")) % BUCKETS
        for n in range(1, MAX_GRAM + 1)
        for k in range(len(w) - n + 1)
        if not (n == 1 and w[k] in "<>")
    )


#: Words whose scores are kept; more than that and the cache starts anew. Longer words' subwords are made each time.
CACHED_WORDS, KEPT_CHARS = 400_000, 64


class Model:
    """scores: (BUCKETS, languages) table; temperature and reject level from calibration."""

    def __init__(self, scores: np.ndarray, bias: np.ndarray, temperature: float, reject: float):
        self.scores, self.bias, self.temperature, self.reject = scores, bias, temperature, reject
        self.index: dict[str, int] = {}
        self.sums = np.zeros((1024, len(LANGUAGES) + 1), np.float32)

    def _row(self, word: str) -> int:
        k = len(self.index)
        ids = list(subwords(word))
        if k == len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        self.sums[k, :-1] = self.scores[ids].sum(0)
        self.sums[k, -1] = len(ids)
        self.index[word] = k
        return k

    def log_probs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log probability of each language, number of subwords) per text; texts without letters have none."""
        total = np.zeros((len(texts), len(LANGUAGES) + 1))
        get, ids, owner = self.index.get, [], []

        def add() -> None:
            """Add the words so far to their texts, which come in order."""
            if ids:
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                total[np.array(owner)[first]] += np.add.reduceat(self.sums[np.array(ids)].astype(np.float64), first, axis=0)

        for n_text, t in enumerate(texts):
            for w in words_of(t):
                k = get(w)
                if k is None:
                    if len(self.index) >= CACHED_WORDS:  # the cache starts anew, with what it gave added up
                        add()
                        self.index, self.sums = {}, np.zeros((1024, len(LANGUAGES) + 1), np.float32)
                        get, ids, owner = self.index.get, [], []
                    k = self._row(w)
                ids.append(k)
                owner.append(n_text)
        add()
        n = total[:, -1]
        z = (total[:, :-1] / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True)), n


def _bags(texts: list[str]) -> list[np.ndarray]:
    return [np.array([h for w in words_of(t) for h in subwords(w)], np.int64) for t in texts]


def _fit(bags: list[np.ndarray], y: np.ndarray, epochs: int, seed: int = 5, rate: float = 0.5, batch: int = 128):
    """SGD with Adagrad steps on mean-embedding softmax; classes weigh alike."""
    rnd = np.random.default_rng(seed)
    emb = rnd.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w, b = np.zeros((DIM, len(LANGUAGES)), np.float32), np.zeros(len(LANGUAGES), np.float32)
    ge, gw, gb = np.full(BUCKETS, 1e-4, np.float32), np.full_like(w, 1e-4), np.full_like(b, 1e-4)
    count = np.bincount(y, minlength=len(LANGUAGES))
    weight = (len(y) / np.maximum(count, 1) / len(LANGUAGES)).astype(np.float32) ** 0.5
    w += rnd.normal(0, 0.1, w.shape).astype(np.float32)
    sizes = np.array([len(x) for x in bags])
    epochs = max(epochs, -(-LEAST_STEPS * batch // max(len(bags), 1)))
    flat, start = np.concatenate(bags), np.concatenate([[0], np.cumsum(sizes)])
    for e in range(epochs):
        order = rnd.permutation(np.flatnonzero(sizes))
        lr = rate * (1 - e / epochs)
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            ids = np.concatenate([flat[start[r] : start[r + 1]] for r in rows])
            n = sizes[rows]
            at = np.concatenate([[0], np.cumsum(n)[:-1]])
            h = np.add.reduceat(emb[ids], at, axis=0) / n[:, None]
            z = h @ w + b
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= weight[y[rows]][:, None] / len(rows)
            dw, db, dh = h.T @ p, p.sum(0), (p @ w.T) / n[:, None]
            gw += dw * dw
            gb += db * db
            w -= lr * dw / np.sqrt(gw)
            b -= lr * db / np.sqrt(gb)
            by = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.diff(ids[by], prepend=-1))
            uniq = ids[by][first]
            d = np.add.reduceat(dh.astype(np.float32)[np.repeat(np.arange(len(rows)), n)[by]], first, axis=0)
            ge[uniq] += (d * d).mean(1)
            emb[uniq] -= lr * d / np.sqrt(ge[uniq])[:, None]
    return emb @ w, b


def _calibrate(scores: np.ndarray, bias: np.ndarray, texts: list[str], y: np.ndarray) -> tuple[float, float]:
    """Temperature of least log loss; the confidence below which held-out sentences are wrong as often as right."""
    best = min(
        ((-Model(scores, bias, t, 0).log_probs(texts)[0][np.arange(len(y)), y].mean(), t) for t in (0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0)),
    )[1]
    lp, _ = Model(scores, bias, best, 0).log_probs(texts)
    conf, right = np.exp(lp.max(1)), lp.argmax(1) == y
    order = np.argsort(conf)
    cut = 0.0
    for k in range(20, len(order), 20):
        if right[order[k - 20 : k]].mean() < 0.5:
            cut = conf[order[k - 1]]
    return best, float(min(cut, 0.9))


def train(sample: list[tuple[str, str]], weights: dict[str, float]) -> Model:
    """sample: (text, language as delivered). Sentences of texts are the training cases."""
    chain = Chain(weights)
    code = {x: k for k, x in enumerate(LANGUAGES)}
    texts, y = [], []
    for text, lang in sample:
        spans = chain.spans(text)
        if len(spans) > SAMPLE_SENTENCES:
            spans = sorted(spans, key=lambda x: zlib.crc32(text[x[0] : x[1]].encode("utf-8", "surrogatepass")))[:SAMPLE_SENTENCES]
        for s, e in spans:
            texts.append(text[s:e])
            y.append(code[lang])
    own = [(s, code[x]) for x in LANGUAGES for s in SEEDS[x] for _ in range(2)]
    delivered = np.array(y, int)
    text_bags, own_bags = _bags(texts), _bags([s for s, _ in own])
    keep = np.arange(0)  # the first fit knows the seeds alone: no label of the sample is believed yet
    fit = None
    for round_, epochs in enumerate((3, 2, 4)):
        cases = [texts[k] for k in keep] + [s for s, _ in own]
        labels = np.concatenate([delivered[keep], [c for _, c in own]]).astype(int)
        held = np.arange(len(cases)) % 10 == 9
        bags = [text_bags[k] for k in keep] + own_bags
        rows = np.flatnonzero(~held)
        fit = _fit([bags[k] for k in rows], labels[rows], epochs)
        if round_ < 2 and texts:
            lp, _ = Model(*fit, 1.0 if round_ else 0.35, 0.0).log_probs(texts)
            agree = lp.argmax(1) == delivered
            keep = np.flatnonzero(agree if round_ else agree | (np.exp(lp.max(1)) < DOUBT))
    test = np.flatnonzero(held)
    return Model(*fit, *_calibrate(*fit, [cases[k] for k in test], labels[test]))


def normal_label(label):
    """The part of a label before ``_`` or ``-``, in lower case; the empty string where there is none."""
    return F.coalesce(F.lower(F.trim(F.regexp_extract(F.col(label), r"^([^_-]*)", 1))), F.lit(""))


def labelled_sample(df: DataFrame, text: str, label: str, key: str, per_language: int) -> list[tuple[str, str]]:
    """About per_language texts of each delivered label, chosen by hash; never more than 2 * per_language * 14.

    Two scans without a shuffle of texts: one counts labels, the other keeps rows whose hash is below a share
    of its label, so the collected part is bounded whatever the size of the input. Texts of over SAMPLE_CHARS
    characters are labelled like all others but not trained on.
    """
    lang = normal_label(label)
    df = df.where(F.length(text).between(1, SAMPLE_CHARS))
    counts = {r[0]: r[1] for r in df.groupBy(lang.alias("x")).count().where(F.col("x").isin(*LANGUAGES)).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(v) for x, n in sorted(counts.items()) for v in (x, min(1.0, per_language / n))])
    unit = (F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)).alias("u")
    rows = (
        df.select(F.col(text).alias("t"), lang.alias("x"), unit)
        .where(F.col("x").isin(*counts) & (F.col("u") < share[F.col("x")]))
        .select("t", "x")
        .limit(2 * per_language * len(LANGUAGES))
        .collect()
    )
    return sorted({(r[0], r[1]) for r in rows})


def segments_of(texts: list[str], chain: Chain, model: Model) -> list[list[tuple[int, int, str, float]]]:
    """For each text its runs of whole sentences in one language: (start, end, language, confidence)."""
    spans, flat = [], []
    for t in texts:
        s = chain.spans(t)
        spans.append(s)
        flat += [t[a:b] for a, b in s]
    lp, n = model.log_probs(flat)
    best, top = lp.argmax(1), np.exp(lp.max(1))
    sure = (n > 0) & (top >= model.reject)
    out, k = [], 0
    for s in spans:
        m = len(s)
        tags = best[k : k + m]
        ok = sure[k : k + m]
        if not m or not (n[k : k + m] > 0).any():
            out.append([])
        else:
            if m > 1 and not (ok.all() and (tags == tags[0]).all()):
                tags = _viterbi(lp[k : k + m], n[k : k + m], ok)
            runs, a = [], 0
            for b in range(1, m + 1):
                if b == m or tags[b] != tags[a]:
                    w = np.maximum(n[k + a : k + b], 1e-9)
                    conf = float(np.exp(lp[k + a : k + b, tags[a]]) @ w / w.sum())
                    runs.append((s[a][0], s[b - 1][1], LANGUAGES[tags[a]], conf))
                    a = b
            out.append(runs)
        k += m
    return out


def _viterbi(lp: np.ndarray, n: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Best tags with a penalty per change; rejected or short sentences have a weak say."""
    say = np.maximum(lp, -12.0) * np.minimum(n / 40.0, 1.0)[:, None] * np.where(sure, 1.0, 0.25)[:, None]
    score, back = say[0], []
    for row in say[1:]:
        change = score.max() - SWITCH
        stay = score >= change
        back.append(np.where(stay, np.arange(len(row)), score.argmax()))
        score = np.where(stay, score, change) + row
    tags = [int(score.argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return np.array(tags[::-1])


def language_segments(df: DataFrame, key: str = "block_id", text: str = "text", label: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """(key, label, n_segments, seg_no, seg_start, seg_end, lang, confidence): every text's runs of one language."""
    weights = fitted()
    model = train(labelled_sample(df, text, label, key, per_language), weights)
    # float16 keeps the broadcast at 1 MB whatever the input's size
    table = df.sparkSession.sparkContext.broadcast(
        (model.scores.astype(np.float16), model.bias, model.temperature, model.reject)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, bias, temperature, reject = table.value
        m = Model(scores.astype(np.float32), bias, temperature, reject)
        chain = Chain(weights)
        for batch in batches:
            rows, cols = [], [[] for _ in range(6)]
            for k, segs in enumerate(segments_of([t or "" for t in batch.column(2).to_pylist()], chain, m)):
                for no, seg in enumerate(segs):
                    rows.append(k)
                    for c, v in zip(cols, (len(segs), no, *seg)):
                        c.append(v)
            at = pa.array(rows, pa.int64())
            types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, t) for c, t in zip(cols, types))],
                names=[key, "label", "n_segments", "seg_no", "seg_start", "seg_end", "lang", "confidence"],
            )

    schema = f"{key} {dict(df.dtypes)[key]}, label string, n_segments int, seg_no int, seg_start int, seg_end int, lang string, confidence double"
    return df.select(F.col(key), normal_label(label).alias("label"), text).mapInArrow(run, schema)


def wrong_labels(segments: DataFrame, key: str = "block_id") -> DataFrame:
    """Rows of texts in one language whose label says otherwise (at 0), and all segments of mixed texts."""
    mixed = F.col("n_segments") > 1
    return segments.where(mixed | (F.col("label") != F.col("lang"))).select(
        key, F.when(mixed, F.col("seg_start")).otherwise(0).alias("seg_start"), "lang"
    )

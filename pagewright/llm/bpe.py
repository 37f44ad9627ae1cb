"""Problem 7: the whole corpus as ids of a public byte-level BPE tokenizer.

Pre-tokenisation runs over the code points of a whole Arrow batch at once, without regex. Each code point becomes a
symbol (its class, and what its right neighbours make of it), and each symbol is a transition function between the
eight states that a piece of the pattern can be in. Functions compose associatively, so the state before every code
point is a prefix scan of compositions: rows of a fixed width are scanned side by side, then the rows' totals, level
by level, with one table lookup per step. Where a piece starts follows from state and symbol. The slices between
boundaries feed pair merging with a cache per distinct piece. Byte offsets of every id can be kept for decoding.

Defined results: null and empty texts give an empty list; strings of special tokens are ordinary text; texts
of any length are encoded whole (merging uses a heap, so a long unbroken piece costs n log n); repeated rows
give repeated rows; extra columns are dropped unless named in ``keep``.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagewright.llm.codes import EDGE, SPACE, class_table, join_codes

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE_ENTRIES, CACHED_BYTES = 400_000, 48


#: States: between pieces; within a run of letters, numbers, other signs, white space; behind a blank that belongs to
#: what follows; within a contraction with one or two letters to go.
CLOSED, LETTERS, NUMBERS, OTHERS, WHITE, GLUED, ONE, TWO = range(8)
#: Symbols: code points by class, apostrophes that a contraction of one or two letters follows, white space that more of
#: it or nothing follows, a last blank, another last white space, and the mark between texts.
S_LETTER, S_NUMBER, S_OTHER, S_APO1, S_APO2, S_WHITE, S_BLANK, S_LAST, S_EDGE = range(9)
#: State after each symbol, by state before.
_NEXT = {
    S_LETTER: {ONE: CLOSED, TWO: ONE, None: LETTERS},
    S_NUMBER: {None: NUMBERS},
    S_OTHER: {None: OTHERS},
    S_APO1: {OTHERS: OTHERS, GLUED: OTHERS, None: ONE},
    S_APO2: {OTHERS: OTHERS, GLUED: OTHERS, None: TWO},
    S_WHITE: {None: WHITE},
    S_BLANK: {None: GLUED},
    S_LAST: {None: CLOSED},
    S_EDGE: {None: CLOSED},
}
#: States in which a symbol goes on with the piece before it.
_GOES_ON = {
    S_LETTER: {LETTERS, GLUED, ONE, TWO}, S_NUMBER: {NUMBERS, GLUED}, S_OTHER: {OTHERS, GLUED}, S_APO1: {OTHERS, GLUED},
    S_APO2: {OTHERS, GLUED}, S_WHITE: {WHITE}, S_BLANK: set(), S_LAST: set(), S_EDGE: set(),
}
WIDTH = 64


@lru_cache(maxsize=1)
def _scan_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(composition table of functions, the state each function gives from CLOSED, starts by state and symbol).

    Functions are numbered: those of the symbols first, the identity next, then all that compositions reach.
    """
    of = [tuple(_NEXT[s].get(q, _NEXT[s][None]) for q in range(8)) for s in range(9)]
    functions = [*of, tuple(range(8))]  # of two symbols with one function the first number stands for both
    number = {}
    for k, f in enumerate(functions):
        number.setdefault(f, k)
    k = 0
    while k < len(functions):
        for j in range(len(functions)):
            for f, g in ((functions[k], functions[j]), (functions[j], functions[k])):
                h = tuple(g[q] for q in f)
                if h not in number:
                    number[h] = len(functions)
                    functions.append(h)
        k += 1
    table = np.array([[number[tuple(g[q] for q in f)] for g in functions] for f in functions], np.uint8)
    assert len(functions) < 256
    starts = np.array([[q not in _GOES_ON[s] for s in range(9)] for q in range(8)])
    return table, np.array([f[CLOSED] for f in functions], np.uint8), starts


IDENTITY = 9


def scanned(f: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of an array of functions."""
    n = len(f)
    if n <= WIDTH:
        out = f.copy()
        for k in range(1, n):
            out[k] = table[out[k - 1], out[k]]
        return out
    rows = -(-n // WIDTH)
    grid = np.full(rows * WIDTH, IDENTITY, np.uint8)
    grid[:n] = f
    cols = np.ascontiguousarray(grid.reshape(rows, WIDTH).T)
    for k in range(1, WIDTH):
        cols[k] = table[cols[k - 1], cols[k]]
    before = np.concatenate([np.full(1, IDENTITY, np.uint8), scanned(cols[-1].copy(), table)[:-1]])
    return table[before[None, :], cols].T.reshape(-1)[:n]


def symbols(codes: np.ndarray) -> np.ndarray:
    """The symbol of each code point: its class, and what the class or letters to its right make of it."""
    cls = class_table()[codes]
    nxt = np.append(cls[1:], np.uint8(EDGE))
    out = np.choose(cls, [S_OTHER, S_LETTER, S_NUMBER, S_WHITE, S_EDGE]).astype(np.uint8)
    last = (cls == SPACE) & (nxt != SPACE) & (nxt != EDGE)
    out[last] = S_LAST
    out[last & (codes == 32)] = S_BLANK
    apo = np.flatnonzero(codes == 39)
    if len(apo):
        a, b = (codes[np.minimum(apo + k, len(codes) - 1)] for k in (1, 2))
        pair = np.zeros(len(apo), bool)
        for x, y in ("re", "ve", "ll"):
            pair |= (a == ord(x)) & (b == ord(y))
        out[apo[np.isin(a, [ord(c) for c in "stmd"])]] = S_APO1
        out[apo[pair]] = S_APO2
    return out


def piece_starts(codes: np.ndarray) -> np.ndarray:
    """Whether a piece of the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?other+|white`` starts at each code point.

    codes: texts joined by edge marks (``join_codes``); edge marks count as starts, to be skipped by the caller.
    """
    table, state, starts = _scan_tables()
    s = symbols(codes)
    before = np.full(len(s), CLOSED, np.uint8)
    before[1:] = state[scanned(s, table)[:-1]]
    return starts[before, s]


class Ranks:
    """Merge ranks of a vocabulary file, with a cache from piece to ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.pair: dict[tuple[int, int], int] = {}

    def encode(self, piece: bytes) -> tuple[int, ...]:
        ids = self.cache.get(piece)
        if ids is None:
            r = self.rank.get(piece)
            ids = (r,) if r is not None else tuple(self.merge(piece))
            if len(piece) <= CACHED_BYTES:
                if len(self.cache) >= CACHE_ENTRIES:
                    self.cache.clear()
                self.cache[piece] = ids
        return ids

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals; a linked list and a heap of pairs."""
        rank, n = self.rank, len(piece)
        end, nxt, before = [*range(1, n + 1)], [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := rank.get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, k, to = heapq.heappop(heap)
            j = nxt[k] if alive[k] else n
            if not alive[k] or j >= n or end[j] != to:
                continue
            alive[j], end[k], nxt[k] = False, to, nxt[j]
            if nxt[k] < n:
                before[nxt[k]] = k
                if (r := rank.get(piece[k : end[nxt[k]]])) is not None:
                    heapq.heappush(heap, (r, k, end[nxt[k]]))
            p = before[k]
            if p >= 0 and (r := rank.get(piece[p:to])) is not None:
                heapq.heappush(heap, (r, p, to))
        return [rank[piece[k : end[k]]] for k in range(n) if alive[k]]


@lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def encode_batch(texts: list[str | None], path: str = DEFAULT_RANKS) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, how many ids each text has)."""
    return _encode([t or "" for t in texts], ranks(path))


def _encode(texts: list[str], r: Ranks) -> tuple[np.ndarray, np.ndarray]:
    codes, starts = join_codes(texts)
    if not len(texts):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    begin = np.flatnonzero(piece_starts(codes))
    width = 1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF)
    width[starts[1:] - 1] = 1
    offset = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(width, out=offset[1:])
    data = "\0".join([*texts, ""]).encode("utf-8", "surrogatepass")
    edge = codes[begin] == 0x110000
    cut = offset[np.append(begin, len(codes))].tolist()
    get, full = r.cache.get, r.encode
    out: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    extend = out.extend
    per_piece = []
    note = per_piece.append
    for a, b, e in zip(cut, cut[1:], edge.tolist()):
        if e:
            note(0)
            continue
        piece = data[a:b]
        ids = get(piece)
        if ids is None:
            ids = full(piece)
        extend(ids)
        note(len(ids))
    ids = np.array(out, np.int32)
    doc = np.searchsorted(starts, begin, "right") - 1
    counts += np.bincount(doc, np.array(per_piece, np.int64), len(texts)).astype(np.int64)
    return ids, counts


def token_bytes(path: str) -> dict[int, bytes]:
    return {v: k for k, v in ranks(path).rank.items()}


def decode(ids: list[int], path: str = DEFAULT_RANKS) -> str:
    """The text of the ids: the exact inverse of encoding."""
    table = token_bytes(path)
    return b"".join(table[i] for i in ids).decode("utf-8", "surrogatepass")


def encode_documents(df: DataFrame, key: str = "doc_id", text: str = "text", ranks_path: str = DEFAULT_RANKS, what: str = "ids") -> DataFrame:
    """(key, ids) of each row; what='count' gives (key, n_tokens); what='offsets' adds where each id ends, in bytes.

    No shuffle: a projection of two columns read in Arrow batches. The ranks load once per Python worker.
    """
    kind = dict(df.dtypes)[key]

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = None
        for batch in batches:
            for at in _slices(batch):
                keys, texts = at.column(0), [t or "" for t in at.column(1).to_pylist()]
                ids, counts = _encode(texts, ranks(ranks_path))
                if what == "count":
                    yield pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64())], names=[key, "n_tokens"])
                    continue
                cuts = np.zeros(len(texts) + 1, np.int32)
                np.cumsum(counts, out=cuts[1:])
                cols, names = [keys, pa.ListArray.from_arrays(cuts, pa.array(ids, pa.int32()))], [key, "ids"]
                if what == "offsets":
                    if sizes is None:
                        by_id = token_bytes(ranks_path)
                        sizes = np.zeros(max(by_id) + 1, np.int64)
                        sizes[[*by_id]] = [len(b) for b in by_id.values()]
                    total = np.cumsum(sizes[ids])
                    base = np.concatenate([[0], total])[cuts[:-1]]
                    ends = total - np.repeat(base, counts)
                    cols.append(pa.ListArray.from_arrays(cuts, pa.array(ends, pa.int64())))
                    names.append("byte_ends")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    shape = {"ids": "ids array<int>", "count": "n_tokens long", "offsets": "ids array<int>, byte_ends array<long>"}[what]
    return df.select(key, text).mapInArrow(ids_of, f"{key} {kind}, {shape}")


def _slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of about ``most`` bytes, so that the arrays of a batch of very long texts stay small."""
    rows = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)

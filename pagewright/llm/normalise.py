"""Problem 5: one form for texts that look the same.

``compat_form``, computed once per distinct value of an Arrow batch, is the form in which texts that look the same are
equal: NFKC, full case folding, blanks mapped to a space, default-ignorable characters removed, look-alike letters
mapped. Texts are grouped by it. As it also equates what prints differently (case, raised and circled digits,
ligatures), ``print_marks`` lists just what the form loses of a text, and an exact check splits each group by it.
``visible_form`` is the readable form of the same classes: it maps what cannot be seen and keeps the rest.

Defined results: null texts have no row; an empty text is a text, equal in look to one of invisible characters
only; line breaks and the number of blanks count; equal texts are no pair; repeated rows count once; texts of
any length are processed whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.nested import nested_nodes
from pagewright.plans.session import cut_lineage

#: Letters of other scripts drawn like Latin ones (fixed values), each with the Latin letter at the same place.
LOOK_ALIKES = (
    ("АВЕКМНОРСТХЅІЈԚԜӀҮѴԌһаеорсухѕіјԁԛԝѵӏүҽ", "ABEKMHOPCTXSIJQWIYVGhaeopcyxsijdqwvlye"),  # Cyrillic
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳονϲ", "ABEZHIKMNOPTYXCjovc"),  # Greek
    ("ՕՍԼօսհոցզ", "OULouhngq"),  # Armenian
    ("ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEHJKLMPRSTVWZ"),  # Cherokee
)
#: Hyphens that print as one short stroke.
HYPHENS = "‐‑⁃﹣"
#: Default-ignorable characters that are not format characters (general category Cf).
IGNORABLE = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))


@lru_cache(maxsize=1)
def _tables() -> tuple[dict, dict]:
    """translate() tables: before composition (ignorables, width forms, blanks, hyphens) and for look-alikes."""
    first: dict[int, str | None] = dict.fromkeys(IGNORABLE)
    # Without Han, Hangul syllables and planes for private use, which have none of these properties.
    for c in chain(range(0x3400), range(0xA000, 0xAC00), range(0xF900, 0x20000), range(0xE0000, 0xE0200)):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind == "Cn" or c in first:
            continue
        if kind == "Cf" and not 0x600 <= c <= 0x605 and c not in (0x6DD, 0x70F, 0x8E2):
            first[c] = None
            continue
        if unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>")):
            first[c] = unicodedata.normalize("NFKC", ch)
        if kind == "Zs" or ch == "\t":
            first[c] = " "
    first.update({ord(h): "-" for h in HYPHENS} | {0xFF0D: "-"})
    alike = {ord(a): b for letters, latin in LOOK_ALIKES for a, b in zip(letters, latin, strict=True)}
    return first, alike


def visible_form(text: str) -> str:
    """The form shared by exactly the texts that print the same."""
    if text.isascii():
        return text.replace("\t", " ")
    first, alike = _tables()
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text.translate(first)).translate(alike))


def _folded(text: str) -> str:
    form = unicodedata.normalize("NFKC", text).casefold()
    return unicodedata.normalize("NFKC", visible_form(form))


def compat_form(text: str) -> str:
    """NFKC with full case folding, over the visible form: equal for all texts that look the same."""
    if text.isascii():
        return text.replace("\t", " ").lower()
    return _folded(visible_form(text))


@lru_cache(maxsize=1 << 16)
def _mark(c: str) -> str:
    """What the folded form loses of a character: nothing, that it is a capital, or which one it is."""
    form = _folded(c)
    return "." if form == c else "^" if form == c.lower() and unicodedata.normalize("NFKC", c) == c else c


#: Marks of ASCII characters, by code.
_ASCII_MARKS = {c: "^" if chr(c).isupper() else "." for c in range(128)}


def print_marks(text: str) -> str:
    """What prints differently within one compat_form: a mark for each character of the visible form."""
    return _key(text)[1]


def _key(text: str) -> tuple[str, str]:
    """(compat_form, print_marks)."""
    if text.isascii():
        return text.replace("\t", " ").lower(), text.translate(_ASCII_MARKS)
    v = visible_form(text)
    return _folded(v), "".join(map(_mark, v))


def _long(data: str, salt: bytes) -> tuple[int, int]:
    h = blake2b(data.encode("utf-8", "surrogatepass"), digest_size=16, salt=salt).digest()
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def _hash_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known: dict[str, tuple] = {}
        rows = []
        for t in batch.column(1).to_pylist():
            got = known.get(t)
            if got is None:
                form, marks = _key(t)
                got = known[t] = (*_long(form, b"c"), _long(marks, b"p")[0], _long(t, b"t")[0])
            rows.append(got)
        cols = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["ref", *LOOK, "exact"])


def text_refs(blocks: DataFrame, bundles: DataFrame, layer: str) -> DataFrame:
    """(ref, text) of all non-null texts of blocks and bundle elements of one layer; repeated rows stay."""
    b = blocks.where((F.col("layer") == layer) & F.col("text").isNotNull())
    e = nested_nodes(bundles.where(F.col("layer") == layer), dedupe=False).where("kind = 'element' and text is not null")
    return b.select(F.concat(F.lit("block:"), F.col("block_id").cast("string")).alias("ref"), "text").unionByName(
        e.select(F.concat(F.lit("elem:"), F.col("bundle_id").cast("string"), F.lit(":"), F.col("node_pos")).alias("ref"), "text")
    )


#: Columns that texts of one look share: the hash of their compat_form, and what tells their prints apart.
LOOK = ("form_a", "form_b", "marks")
#: A text with very many copies is spread over so many parts when its pairs are given their refs.
SALTS = 16


def _looks(texts: DataFrame) -> DataFrame:
    """(ref, form_a, form_b, marks, exact) of the texts that share their look with a different text.

    Texts leave the Python stage as four hashes. Keys with more than one distinct text are found by a map-side
    combined aggregate, so a group holding a third of all rows costs a few partial sums.
    """
    keys = cut_lineage(texts.mapInArrow(_hash_forms, "ref string, form_a long, form_b long, marks long, exact long"))
    varied = keys.groupBy(*LOOK).agg(F.min("exact").alias("lo"), F.max("exact").alias("hi")).where("lo <> hi").select(*LOOK)
    return keys.join(varied, [*LOOK], "left_semi").dropDuplicates(["ref", *LOOK, "exact"])


def look_alikes(texts: DataFrame) -> DataFrame:
    """(ref_a, ref_b) of all texts that look the same but differ.

    Pairs are formed between distinct texts first and then given their refs, so copies of one text are never compared
    with each other; the copies of a text are salted, so that none of the joins has one key for all of them.
    """
    some = cut_lineage(_looks(texts))
    forms = some.select(*LOOK, "exact").dropDuplicates()
    pairs = forms.withColumnRenamed("exact", "ea").join(forms.withColumnRenamed("exact", "eb"), [*LOOK]).where("ea < eb")
    salt = lambda ref, name: F.pmod(F.xxhash64(ref), F.lit(SALTS)).alias(name)
    every = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias(name)
    left = some.select(*LOOK, F.col("exact").alias("ea"), F.col("ref").alias("ra"), salt("ref", "sa"))
    right = some.select(*LOOK, F.col("exact").alias("eb"), F.col("ref").alias("rb"), salt("ref", "sb"))
    return (
        pairs.select("*", every("sa"))
        .join(left, [*LOOK, "ea", "sa"])
        .select("*", every("sb"))
        .join(right, [*LOOK, "eb", "sb"])
        .select(F.least("ra", "rb").alias("ref_a"), F.greatest("ra", "rb").alias("ref_b"))
    )


def look_classes(texts: DataFrame) -> DataFrame:
    """(ref, look, n_texts): the compact form of the same result, one row per text that shares its look with others.

    look names the class, n_texts says how many different texts it holds; its pairs are all pairs of them.
    """
    some = cut_lineage(_looks(texts))
    sizes = some.groupBy(*LOOK).agg(F.countDistinct("exact").alias("n_texts"))
    return some.join(sizes, [*LOOK]).select("ref", F.sha1(F.concat_ws("/", *LOOK)).alias("look"), "n_texts")


def normalised_texts(texts: DataFrame) -> DataFrame:
    """(ref, visible, compat): every text in its two forms."""

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, tuple[str, str]] = {}
            out = []
            for t in batch.column(1).to_pylist():
                got = known.get(t)
                if got is None:
                    got = known[t] = (visible_form(t), compat_form(t))
                out.append(got)
            cols = [pa.array(c, pa.string()) for c in (zip(*out) if out else [[]] * 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["ref", "visible", "compat"])

    return texts.mapInArrow(forms, "ref string, visible string, compat string")

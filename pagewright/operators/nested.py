"""Problem 1: deeply nested records to flat, linked tables by Dewey labelling.

Every node of a bundle's payload gets an ordinal path label (its Dewey position): a top element its
index in ``elements``, a kid its parent's label, ``.`` and its index in ``Kids``, a file its element's
label, ``#`` and its index in ``filePaths``. The parent link is the label with its last step cut off,
and nodes are grouped into tables by their schema path (the Path without ordinals).

Defined results
---------------
* payload null, not valid JSON, or not an object: no rows.
* ``elements``/``Kids`` absent or null: no children. A lone object counts as an array of one.
* null or non-object entries of ``elements``/``Kids``: no row, but they keep their index.
* ``filePaths`` a lone string: index 0; null entries keep their index without a row; ``[]``: no rows.
* ``Page`` as integer, integral decimal, or string of one: used; anything else counts as absent, and
  the nearest containing element's page holds; without one page_id is -1.
* ``Bounds`` of other than four numbers: all four coordinates null.
* exact duplicate input rows count once. Extra columns of the input are ignored.
* Depth is bounded by memory only for the walk (it uses a stack); nesting deeper than the JSON parser's
  limit is read by a slower parser without one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "bundle_id long, doc_id long, kind string, node_pos string, page_id long, path string, "
    "text string, text_size double, x0 double, y0 double, x1 double, y1 double, width double, height double, "
    "attrs string"
)
_NAMES = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
_ARROW = pa.schema(
    [
        (n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[k])
        for n, k in (c.split() for c in NODE_SCHEMA.split(", "))
    ]
)
_KNOWN = {"Page", "Bounds", "Path", "Text", "TextSize", "filePaths", "Kids"}
_SURROGATE = re.compile("[\ud800-\udfff]")
_ROWS_PER_BATCH = 20_000


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def _deep_loads(s: str):
    """A JSON reader on an explicit stack, for payloads nested beyond the recursion limit of json.loads."""
    scan, white = json.JSONDecoder(parse_constant=_no_constant), re.compile(r"[ \t\n\r]*")
    i, stack, done = white.match(s, 0).end(), [], None
    key: str | None = None
    while True:
        c = s[i : i + 1]
        if c in ("{", "["):
            box = {} if c == "{" else []
            stack.append((box, key))
            i = white.match(s, i + 1).end()
            if s[i : i + 1] == ("}" if c == "{" else "]"):
                value, key = stack.pop()
                i += 1
            else:
                key = None
                if c == "{":
                    key, i = _key(scan, white, s, i)
                continue
        else:
            value, i = scan.raw_decode(s, i)
        while True:
            i = white.match(s, i).end()
            if not stack:
                if i != len(s):
                    raise ValueError("extra data")
                return value
            box, outer = stack[-1]
            if isinstance(box, dict):
                box[key] = value
            else:
                box.append(value)
            c = s[i : i + 1]
            if c == ",":
                i = white.match(s, i + 1).end()
                key = None
                if isinstance(box, dict):
                    key, i = _key(scan, white, s, i)
                break
            if c != ("}" if isinstance(box, dict) else "]"):
                raise ValueError("delimiter expected")
            value, key = stack.pop()
            i += 1


def _key(scan: json.JSONDecoder, white: re.Pattern, s: str, i: int) -> tuple[str, int]:
    name, i = scan.raw_decode(s, i)
    i = white.match(s, i).end()
    if not isinstance(name, str) or s[i : i + 1] != ":":
        raise ValueError("key expected")
    return name, white.match(s, i + 1).end()


def parse_payload(payload: str | None):
    """The object of a payload, or None where it is null, not valid JSON or no object."""
    if payload is None:
        return None
    try:
        top = json.loads(payload, parse_constant=_no_constant)
    except RecursionError:
        try:
            top = _deep_loads(payload)
        except (ValueError, RecursionError):
            return None
    except ValueError:
        return None
    return top if isinstance(top, dict) else None


def as_int(v) -> int | None:
    """An integer also from an integral decimal or a string of one; booleans and the rest are None."""
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, str):
        try:
            v = float(v)
        except ValueError:
            return None
    if isinstance(v, float):
        if v != v or v in (float("inf"), float("-inf")) or v != int(v):
            return None
        v = int(v)
    return v if isinstance(v, int) and -(2**62) < v < 2**62 else None


def as_float(v) -> float | None:
    if isinstance(v, bool) or not isinstance(v, (int, float, str)):
        return None
    try:
        out = float(v)
    except (ValueError, OverflowError):
        return None
    return out if out == out and abs(out) != float("inf") else None


def as_text(v) -> str | None:
    """A string as it is (lone surrogates become U+FFFD); other values as JSON."""
    if v is None:
        return None
    if not isinstance(v, str):
        v = json.dumps(v, ensure_ascii=False)
    return _SURROGATE.sub("�", v) if _SURROGATE.search(v) else v


def as_list(v) -> list:
    """An array as it is; a lone value as an array of one; null as none."""
    return v if isinstance(v, list) else [] if v is None else [v]


def container(top: dict, name: str):
    """elements or pages, at the top or one level down under structuredData."""
    if name in top:
        return top[name]
    inner = top.get("structuredData")
    return inner.get(name) if isinstance(inner, dict) else None


def _box(v) -> tuple:
    if isinstance(v, list) and len(v) == 4:
        nums = tuple(as_float(x) for x in v)
        if None not in nums:
            return nums
    return (None,) * 4


def walk(top: dict) -> Iterator[tuple]:
    """(kind, node_pos, page_id, path, text, text_size, box, width, height, attrs) of every node."""
    for k, p in enumerate(as_list(container(top, "pages"))):
        if isinstance(p, dict):
            no = as_int(p.get("page_number"))
            yield (
                "page", str(k), -1 if no is None else no + 1, None, None, None, (None,) * 4,
                as_float(p.get("width")), as_float(p.get("height")), None,
            )
    stack = [(e, str(k), -1) for k, e in enumerate(as_list(container(top, "elements"))) if isinstance(e, dict)]
    stack.reverse()
    while stack:
        e, pos, page = stack.pop()
        own = as_int(e.get("Page"))
        page = page if own is None else own + 1
        path = as_text(e.get("Path"))
        rest = {k: v for k, v in e.items() if k not in _KNOWN}
        yield (
            "element", pos, page, path, as_text(e.get("Text")), as_float(e.get("TextSize")), _box(e.get("Bounds")),
            None, None, as_text(json.dumps(rest, sort_keys=True)) if rest else None,
        )
        for k, f in enumerate(as_list(e.get("filePaths"))):
            if f is not None:
                yield ("file", f"{pos}#{k}", page, path, as_text(f), None, (None,) * 4, None, None, None)
        stack += [(c, f"{pos}.{k}", page) for k, c in reversed([*enumerate(as_list(e.get("Kids")))]) if isinstance(c, dict)]


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        cols = [*zip(*rows)]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)

    for batch in batches:
        ids, docs, payloads = (batch.column(k).to_pylist() for k in range(3))
        for bid, doc, payload in zip(ids, docs, payloads):
            top = parse_payload(payload)
            if top is None:
                continue
            for kind, pos, page, path, text, size, box, w, h, attrs in walk(top):
                rows.append((bid, doc, kind, pos, page, path, text, size, *box, w, h, attrs))
                if len(rows) >= _ROWS_PER_BATCH:
                    yield flush()
    if rows:
        yield flush()


def nested_nodes(bundles: DataFrame, dedupe: bool = True) -> DataFrame:
    """One row per page, element and file of every bundle, with Dewey label, parent link and schema path.

    parent_pos is the label truncated by its last step (for top nodes the empty string); schema_path is the
    Path with ordinals removed. Only the needed columns are read. With dedupe=False the caller removes the
    rows of repeated deliveries itself, which is cheaper where it keeps few narrow columns.
    """
    src = bundles.dropDuplicates() if dedupe else bundles
    return src.select("bundle_id", "doc_id", "payload").mapInArrow(_label, NODE_SCHEMA).select(
        "bundle_id", "doc_id", "kind", "node_pos",
        F.regexp_replace("node_pos", r"[.#]?[0-9]+$", "").alias("parent_pos"),
        "page_id", "path", F.regexp_replace("path", r"\[[0-9]+\]", "").alias("schema_path"),
        "text", "text_size", "x0", "y0", "x1", "y1", "width", "height", "attrs",
    )


def element_table(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'element'").drop("kind", "width", "height")


def file_table(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'file'").select(
        "bundle_id", "doc_id", "node_pos", "parent_pos", "page_id", "path", "schema_path", F.col("text").alias("file_path")
    )


def page_table(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'page'").select("bundle_id", "doc_id", "node_pos", "page_id", "width", "height")


def schema_tables(nodes: DataFrame) -> DataFrame:
    """One row per schema path: how many nodes, of how many bundles, form that table."""
    per = nodes.where("kind <> 'page'").groupBy("kind", "schema_path", "bundle_id").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("t"))
    return per.groupBy("kind", "schema_path").agg(
        F.sum("n").alias("n_nodes"), F.count("bundle_id").alias("n_bundles"), F.sum("t").alias("n_texts")
    )

"""Queries of problem 1."""

from __future__ import annotations

from pagewright.operators import nested
from pagewright.plans.session import table


def _nodes(spark, d):
    return nested.nested_nodes(table(spark, d, "bundles"))


def p1_found(spark, d):
    nodes = nested.nested_nodes(table(spark, d, "bundles"), dedupe=False)
    return nodes.where("kind <> 'page'").select("bundle_id", "node_pos", "parent_pos", "page_id").dropDuplicates()


def _narrow(spark, d):
    return nested.nested_nodes(table(spark, d, "bundles"), dedupe=False)


QUERIES = {
    "p1_found": p1_found,
    "p1_elements": lambda s, d: nested.element_table(_nodes(s, d)),
    "p1_files": lambda s, d: nested.file_table(_narrow(s, d)).dropDuplicates(),  # narrow rows: cheaper than shuffling payloads
    "p1_pages": lambda s, d: nested.page_table(_narrow(s, d)).dropDuplicates(),
    "p1_schema_tables": lambda s, d: nested.schema_tables(_nodes(s, d)),
}

_PAGE = """CASE WHEN json_type(e, '$.Page') IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'VARCHAR') AND trunc(try_cast(e->>'$.Page' AS DOUBLE)) = try_cast(e->>'$.Page' AS DOUBLE)
  THEN try_cast(e->>'$.Page' AS DOUBLE)::BIGINT + 1 END"""


def _items(value: str, path: str) -> str:
    """A list of what stands at a path: the entries of an array, a lone value as the only entry, nothing for null."""
    return (
        f"CASE json_type({value}, '{path}') WHEN 'ARRAY' THEN json_extract({value}, '{path}[*]') WHEN 'NULL' THEN []::JSON[] "
        f"ELSE CASE WHEN json_type({value}, '{path}') IS NULL THEN []::JSON[] ELSE [json_extract({value}, '{path}')] END END"
    )


_NUMBER = "CASE WHEN json_type({0}, '{1}') IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'VARCHAR') AND isfinite(try_cast({0}->>'{1}' AS DOUBLE)) THEN try_cast({0}->>'{1}' AS DOUBLE) END"
_KIDS = _items("e", "$.Kids")
_NODES = f"""WITH RECURSIVE ok AS (SELECT DISTINCT bundle_id, doc_id, payload::JSON AS j FROM bundles WHERE payload IS NOT NULL AND json_valid(payload) AND json_type(CASE WHEN json_valid(payload) THEN payload ELSE '0' END) = 'OBJECT'),
top_ AS (SELECT bundle_id, doc_id, CASE WHEN json_type(j, '$.elements') IS NOT NULL THEN {_items('j', '$.elements')} ELSE {_items('j', '$.structuredData.elements')} END AS xs FROM ok),
nodes AS (
  SELECT bundle_id, doc_id, (i - 1)::VARCHAR AS node_pos, '' AS parent_pos, xs[i] AS e, NULL::BIGINT AS above
  FROM (SELECT bundle_id, doc_id, xs, unnest(range(1, len(xs) + 1)) AS i FROM top_) WHERE json_type(xs[i]) = 'OBJECT'
  UNION ALL
  SELECT bundle_id, doc_id, node_pos || '.' || (i - 1), node_pos, ks[i], page
  FROM (SELECT bundle_id, doc_id, node_pos, page, ks, unnest(range(1, len(ks) + 1)) AS i
    FROM (SELECT bundle_id, doc_id, node_pos, coalesce({_PAGE}, above) AS page, {_KIDS} AS ks FROM nodes)) WHERE json_type(ks[i]) = 'OBJECT'),
paged AS (SELECT *, coalesce({_PAGE}, above, -1) AS page_id, e->>'$.Path' AS path, regexp_replace(e->>'$.Path', '\\[[0-9]+\\]', '', 'g') AS schema_path, e->>'$.Text' AS text FROM nodes),
files AS (SELECT bundle_id, doc_id, node_pos || '#' || (i - 1) AS node_pos, node_pos AS parent_pos, page_id, path, schema_path, fs[i]->>'$' AS file_path
  FROM (SELECT *, unnest(range(1, len(fs) + 1)) AS i FROM (SELECT *, {_items('e', '$.filePaths')} AS fs FROM paged)) WHERE json_type(fs[i]) <> 'NULL'),
ptop AS (SELECT bundle_id, doc_id, CASE WHEN json_type(j, '$.pages') IS NOT NULL THEN {_items('j', '$.pages')} ELSE {_items('j', '$.structuredData.pages')} END AS xs FROM ok),
ps AS (SELECT bundle_id, doc_id, (i - 1)::VARCHAR AS node_pos, xs[i] AS e FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM ptop) WHERE json_type(xs[i]) = 'OBJECT'),
pages_ AS (SELECT bundle_id, doc_id, node_pos, coalesce({_PAGE.replace('$.Page', '$.page_number')}, -1) AS page_id, {_NUMBER.format('e', '$.width')} AS width, {_NUMBER.format('e', '$.height')} AS height FROM ps)"""

_BOX = ", ".join(_NUMBER.format("e", f"$.Bounds[{k}]") + f" AS b{k}" for k in range(4))
_TITLED = "regexp_matches(path, '^//Document/(Sect/)?Title')"
#: Blocks, pages and contents of bundles: placed elements in the order of the walk, y counted from the top.
_BUNDLES = f"""{_NODES},
walked AS (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY list_transform(string_split(node_pos, '.'), lambda x: x::INT)) AS ord, {_NUMBER.format('e', '$.TextSize')} AS size,
  json_type(e, '$.Bounds') = 'ARRAY' AND json_array_length(e, '$.Bounds') = 4 AS four, {_BOX} FROM paged),
titles AS (SELECT bundle_id, arg_min(text, ord) AS title FROM walked WHERE {_TITLED} AND text <> '' GROUP BY bundle_id),
placed AS (SELECT * FROM walked WHERE page_id >= 1 AND four AND b0 IS NOT NULL AND b1 IS NOT NULL AND b2 IS NOT NULL AND b3 IS NOT NULL),
said AS (SELECT placed.*, titles.title FROM placed LEFT JOIN titles USING (bundle_id) WHERE text IS NOT NULL),
sizes AS (SELECT bundle_id, page_id, max(width) AS w, max(height) AS h FROM pages_ GROUP BY ALL),
per AS (SELECT bundle_id, page_id, max(b2) AS mx, max(b3) AS my, arg_min(b1, ord) AS fy, min(ord) AS first_ FROM said GROUP BY ALL),
turned AS (SELECT bundle_id, page_id, row_number() OVER (PARTITION BY bundle_id ORDER BY first_) AS page_ord, coalesce(w, mx) AS width, coalesce(h, my) AS height, fy > coalesce(h, my) / 2 AS up FROM per LEFT JOIN sizes USING (bundle_id, page_id))"""
_TOP, _BOTTOM = "CASE WHEN up THEN height - b3 ELSE b1 END", "CASE WHEN up THEN height - b1 ELSE b3 END"

SQL = {
    "p1_found": f"{_NODES} SELECT bundle_id, node_pos, parent_pos, page_id FROM paged UNION ALL SELECT bundle_id, node_pos, parent_pos, page_id FROM files",
    "p1_files": f"{_NODES} SELECT bundle_id, doc_id, node_pos, parent_pos, page_id, path, schema_path, file_path FROM files",
    "p1_pages": f"{_NODES} SELECT bundle_id, doc_id, node_pos, page_id, width, height FROM pages_",
    "p1_schema_tables": f"""{_NODES}, every AS (SELECT 'element' AS kind, schema_path, bundle_id, text FROM paged UNION ALL SELECT 'file', schema_path, bundle_id, file_path FROM files)
        SELECT kind, schema_path, count(*) AS n_nodes, count(DISTINCT bundle_id) AS n_bundles, count(text) AS n_texts FROM every GROUP BY kind, schema_path""",
    "bundle_blocks": f"""{_BUNDLES} SELECT bundle_id AS doc_id, page_id::INT AS page_id, page_ord::INT AS page_ord, ord::INT AS ord, path, text, coalesce(size, 0.0) AS font_size, b0 AS x0, {_TOP} AS y0, b2 AS x1, {_BOTTOM} AS y1
        FROM said JOIN turned USING (bundle_id, page_id) WHERE NOT (coalesce({_TITLED}, false) AND coalesce(text = title, false))""",
    "bundle_pages": f"""{_BUNDLES},
        used AS (SELECT bundle_id, page_id, trunc(coalesce(size, 0.0))::INT AS main_font_size, sum(length(text)) AS n, min(ord) AS o FROM said GROUP BY ALL),
        fonts AS (SELECT bundle_id, page_id, main_font_size FROM used QUALIFY row_number() OVER (PARTITION BY bundle_id, page_id ORDER BY n DESC, o) = 1)
        SELECT bundle_id AS doc_id, page_id::INT AS page_id, page_ord::INT AS page_ord, width, height, title, main_font_size FROM turned JOIN fonts USING (bundle_id, page_id) LEFT JOIN titles USING (bundle_id)""",
    "bundle_contents": f"""{_BUNDLES},
        owned AS (SELECT placed.*, turned.up, turned.height, files.node_pos AS file_pos, file_path FROM placed JOIN turned USING (bundle_id, page_id) JOIN files ON files.bundle_id = placed.bundle_id AND files.parent_pos = placed.node_pos WHERE placed.text IS NULL),
        k AS (SELECT *, CASE WHEN regexp_matches(path, '^//Document/(.*)?Figure') THEN 'IMAGE' WHEN regexp_matches(path, '^//Document/(.*)?Table') AND ends_with(file_path, 'xlsx') THEN 'TABLE' END AS kind FROM owned)
        SELECT bundle_id AS doc_id, page_id::INT AS page_id, ord::INT AS ord, sha256(bundle_id || '|' || file_pos) AS content_id, kind, file_path AS path, b0 AS x0, {_TOP} AS y0, b2 AS x1, {_BOTTOM} AS y1 FROM k WHERE kind IS NOT NULL""",
}

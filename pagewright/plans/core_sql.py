"""The results of the core queries in SQL, for comparison on the same tables.

Nothing is taken from the engine: patterns, limits and rules are written out here from their definitions, so that a
wrong one in the engine shows.
"""

from __future__ import annotations

W = r"[\s\x{3000}\x{00A0}]"
FULL_WIDTH, HALF_WIDTH = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　", "".join(chr(c) for c in range(0x21, 0x7F)) + " "
BIDI = "\u202a\u202b\u202c\u202d\u202e"
#: Hiragana, katakana, iteration and zero marks, radicals, Han with extension A and compatibility forms.
KANA_HAN = "[ぁ-んァ-ヴ々〇\u2e80-\u2fd5\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]"
#: Digits, bare, bracketed or half bracketed; circled digits; Roman numerals; one letter up to r, bare or bracketed.
INDEX_ALONE = r"^([0-9]+|\([0-9]+\)|[0-9]+\)|[①-⑩]|[\x{2160}-\x{217F}]+|[IXV]+|[ixv]+|[a-rA-R]|\([a-rA-R]\))$"
TABLE_PATH, TITLE_PATH = "^//Document/(.*)?Table", "^//Document/(Sect/)?Title"
HEAD_PATH, BODY_PATH = "^//Document/(H|Sect.*/H)", "^//Document/(H|P|L|Sect.*/H|Sect.*/P|Sect.*/L)"
CAPTION_PATH = "^//Document/(H|L|Title|Sect/Title|Sect.*/H|Sect.*/L)"
TOC_PATH = "^//Document/(TOC|Reference|(Sect|L).*/TOC|(Sect|L).*/Reference|L/LI.*/Lbl)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _half(c: str) -> str:
    return f"translate({c}, {_q(FULL_WIDTH)}, {_q(HALF_WIDTH)})"


def _lang(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NULL THEN NULL WHEN regexp_matches({c}, {_q(INDEX_ALONE)}) THEN '' WHEN regexp_matches({c}, {_q(KANA_HAN)}) THEN 'ja_JP' "
        f"WHEN regexp_matches({c}, '^[ -~]*$') OR regexp_matches({c}, '[a-zA-Z]') THEN 'en_US' ELSE '' END"
    )


def _clean(c: str) -> str:
    t = f"replace(translate({c}, {_q(BIDI)}, ''), chr(10), '')"
    return f"regexp_replace(regexp_replace({_half(t)}, '\\(<http.+?>\\)', '', 'g'), '\\(<>\\)', '', 'g')"


def _ends(c: str, lang: str) -> str:
    return f"CASE {lang} WHEN 'ja_JP' THEN regexp_matches({c}, '[。.~]{W}*$') WHEN 'en_US' THEN regexp_matches({c}, '[.?!~]{W}*$') ELSE false END"


def _spaced(t: str, lang: str) -> str:
    return f"CASE {lang} WHEN 'ja_JP' THEN regexp_replace({t}, '([。.~]){W}+', '\\1 ', 'g') WHEN 'en_US' THEN regexp_replace({t}, '([.?!~]){W}+', '\\1 ', 'g') ELSE {t} END"


# Labels one after the other: the state is what was found, parted by chr(1), then chr(2) and the text that is left.
_LABEL_SQL = "(fig|figure|image|table|scheme|図|表|画像)+[.\\- \\x{3000}]*[0-9]+"


def _labels(c: str) -> str:
    text = f"lower({_half(c)})"
    t, hit = "split_part(s, chr(2), 2)", f"regexp_extract(split_part(s, chr(2), 2), {_q(_LABEL_SQL)})"
    step = f"CASE WHEN {hit} = '' THEN s ELSE split_part(s, chr(2), 1) || replace({hit}, ' ', '') || chr(1) || chr(2) || replace({t}, {hit}, '') END"
    runs = f"list_prepend(chr(2) || {text}, regexp_extract_all({text}, '[0-9]+'))"
    return f"list_filter(string_split(split_part(list_reduce({runs}, lambda s, x: {step}), chr(2), 1), chr(1)), lambda x: x <> '')"


# Blocks and pages without repeated rows, y counted from the top.
_BASE = f"""WITH b AS (SELECT DISTINCT * FROM blocks WHERE text IS NOT NULL),
p AS (SELECT DISTINCT * FROM pages),
f AS (SELECT doc_id, page_id, arg_min(y0, ord) AS first_y FROM b GROUP BY doc_id, page_id),
o AS (SELECT b.*, p.height, p.width, p.main_font_size, p.title, f.first_y > p.height / 2 AS from_bottom,
  CASE WHEN f.first_y > p.height / 2 THEN p.height - b.y1 ELSE b.y0 END AS top,
  CASE WHEN f.first_y > p.height / 2 THEN p.height - b.y0 ELSE b.y1 END AS bottom
  FROM b JOIN p USING (doc_id, page_id) JOIN f USING (doc_id, page_id)),
g AS (SELECT *, top <= height * 0.05 OR bottom >= height * (1 - 0.05) AS in_margin, font_size < main_font_size AS is_small,
  regexp_matches(path, {_q(TABLE_PATH)}) AS in_table FROM o),
body AS (SELECT * FROM g WHERE NOT in_margin AND NOT is_small),
valid AS (SELECT * FROM body WHERE NOT in_table)"""

_NORMAL = f"SELECT *, {_clean('text')} AS t0 FROM"
_SENTENCES = f"""{_BASE},
n0 AS ({_NORMAL} valid),
n1 AS (SELECT *, {_lang('t0')} AS l0 FROM n0),
n2 AS (SELECT *, {_spaced('t0', 'l0')} AS t FROM n1),
n3 AS (SELECT *, {_lang('t')} AS lg FROM n2),
n4 AS (SELECT *, CASE lg WHEN 'ja_JP' THEN regexp_replace(t || ' ', '([。.~]){W}', '\\1' || chr(1), 'g')
  WHEN 'en_US' THEN regexp_replace(t || ' ', '([.?!~]){W}', '\\1' || chr(1), 'g') ELSE t || ' ' END AS cut FROM n3),
n5 AS (SELECT doc_id, page_id, block_id, list_filter(list_transform(string_split(cut, chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM n4),
sentences AS (SELECT doc_id, page_id, block_id, unnest(range(len(ss)))::INT AS sent_no, unnest(ss) AS sentence FROM n5)"""

_CONTENTS = "c AS (SELECT DISTINCT * FROM contents)"
_CAPTIONS = f"""cap0 AS (SELECT *, {_labels('text')} AS ls FROM o WHERE regexp_matches(path, '/Caption')),
cap AS (SELECT doc_id, page_id, ord, block_id, unnest(ls) AS label, unnest(range(len(ls))) AS label_no, trim(text) AS meta, x0, top AS y0 FROM cap0)"""
_NEAR = f"""{_BASE}, {_CONTENTS}, {_CAPTIONS},
dist AS (SELECT c.content_id, cap.ord AS cap_ord, cap.label, sqrt((c.x0 - cap.x0) ** 2 + (c.y0 - cap.y0) ** 2) AS upper,
  sqrt((c.x0 - cap.x0) ** 2 + (c.y1 - cap.y0) ** 2) AS lower FROM c JOIN cap USING (doc_id, page_id)),
up AS (SELECT content_id, label AS upper_label, upper AS upper_distance FROM dist WHERE upper < 150 QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY upper, cap_ord, label) = 1),
lo AS (SELECT content_id, label AS lower_label, lower AS lower_distance FROM dist WHERE lower < 150 QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY lower, cap_ord, label) = 1),
near AS (SELECT c.content_id, c.doc_id, c.kind, upper_label, upper_distance, lower_label, lower_distance FROM c LEFT JOIN up USING (content_id) LEFT JOIN lo USING (content_id))"""

# feature, level, rule, condition; a heading counts at the first level of a feature that it matches.
_BRACKETED = "length(regexp_extract(text, '^[(|【](.+?)[)|】].*$', 1)) >= 2 AND NOT regexp_matches(regexp_extract(text, '^[(|【](.+?)[)|】].*$', 1), '[0-9a-zA-Z]')"
_CONDITIONS = (
    ("japanese_legal", 0, 0, _BRACKETED),
    ("japanese_legal", 1, 1, f"regexp_matches(text, '^第[0-9]*.*条') AND NOT ({_BRACKETED})"),
    ("english_legal", 0, 0, "regexp_matches(text, '^(Article|ARTICLE)')"),
    ("english_legal", 0, 1, rf"regexp_matches(text, '^[0-9].*\.{W}')"),
    ("english_legal", 0, 2, rf"regexp_matches(text, '^[Ⅰ-Ⅹ].*\.{W}')"),
    ("english_legal", 0, 3, rf"regexp_matches(text, '^[IXV]+\.{W}')"),
    ("general", 0, 0, rf"regexp_matches(text, '^[0-9]+[.\-\s　].*{W}')"),
    ("general", 0, 1, rf"regexp_matches(text, '^[Ⅰ-Ⅹ]+[.\-\s　].*{W}')"),
    ("general", 0, 2, rf"regexp_matches(text, '^[IXV]+[.\-\s　].*{W}')"),
)
_FEATURES = [f"SELECT doc_id, '{f}' AS feature, {level} AS level, {no} AS rule, trunc(x0)::INT AS x0 FROM heads WHERE {hit}" for f, level, no, hit in _CONDITIONS]
_CAPTION_RULES = {"japanese_legal": "契約書|同意書", "english_legal": "Contract|CONTRACT|Agreement|AGREEMENT", "general": "^.*"}
_HITS = f"""{_BASE},
heads AS (SELECT * FROM body WHERE regexp_matches(path, {_q(CAPTION_PATH)})),
hits AS ({' UNION ALL '.join(_FEATURES)})"""
_ADOPTED = f"""{_HITS},
hn AS (SELECT doc_id, feature, level, rule, count(*) AS n FROM hits GROUP BY ALL),
adopted AS (SELECT * FROM hn QUALIFY row_number() OVER (PARTITION BY doc_id, feature ORDER BY level, n DESC, rule) = 1)"""
_COORDS = f"""{_ADOPTED},
per AS (SELECT doc_id, feature, x0, count(*) AS n FROM hits JOIN adopted USING (doc_id, feature, level, rule) GROUP BY doc_id, feature, x0),
bounds AS (SELECT doc_id, feature, max(n) AS hi, min(n) AS lo, quantile_cont(n::DOUBLE, 0.8) AS p FROM per GROUP BY doc_id, feature),
coords AS (SELECT doc_id, feature, string_agg(x0::VARCHAR, ',' ORDER BY x0) AS x0s, sum(n)::BIGINT AS frequency FROM per JOIN bounds USING (doc_id, feature)
  WHERE hi - lo < 5 OR n >= p - 1e-9 GROUP BY doc_id, feature)"""
_CAPHIST = "caps AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{f}' AS feature FROM ct WHERE regexp_matches(text, {_q(p)})" for f, p in _CAPTION_RULES.items()
) + "), caphist AS (SELECT doc_id, feature, count(*) AS n_captions FROM caps GROUP BY ALL)"
_CT = "ct AS (SELECT doc_id, text FROM heads UNION ALL SELECT doc_id, title FROM (SELECT DISTINCT doc_id, page_id, title FROM o WHERE title IS NOT NULL))"
_SLIDES = """votes AS (SELECT doc_id, avg(CASE WHEN (abs(width / height - 4.0 / 3.0) < 0.01 OR abs(width / height - 16.0 / 9.0) < 0.01) AND main_font_size > 16 THEN 1.0 ELSE 0.0 END)::DOUBLE AS slide_share
  FROM (SELECT DISTINCT * FROM pages) GROUP BY doc_id)"""
_LINKED = f"""{_SENTENCES}, {_CONTENTS},
lab AS (SELECT doc_id, page_id, block_id, sent_no, unnest({_labels('sentence')}) AS label FROM sentences),
cl AS (SELECT content_id, doc_id, page_id, ord, kind, path, coalesce(replace(lower({_half('label')}), ' ', ''), '') AS label FROM c),
unref AS (SELECT cl.* FROM cl WHERE NOT EXISTS (SELECT 1 FROM lab WHERE lab.doc_id = cl.doc_id AND lab.label = cl.label))"""
_FLAGS = f"""{_BASE}, l AS (SELECT *, {_lang('text')} AS lg FROM body)"""
_HEAD = f"regexp_matches(path, {_q(HEAD_PATH)}) AND NOT ({_ends('trim(text)', 'lg')})"
_LONG = _q(r"^((?:[0-9]+|\([0-9]+\)|[0-9]+\)|[\x{2460}-\x{2469}]|[\x{2160}-\x{2169}]+)[.\-\s](?:.+?\s){2})(.*)$")

SQL = {
    "sentence_split": f"{_SENTENCES} SELECT * FROM sentences",
    "main_font_size": """WITH b AS (SELECT DISTINCT * FROM blocks WHERE text IS NOT NULL),
        s AS (SELECT doc_id, page_id, trunc(font_size)::INT AS main_font_size, sum(length(text)) AS n, min(ord) AS o FROM b GROUP BY ALL)
        SELECT doc_id, page_id, main_font_size FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, page_id ORDER BY n DESC, o) = 1""",
    "document_font_mode": """WITH b AS (SELECT DISTINCT * FROM blocks WHERE text IS NOT NULL),
        s AS (SELECT doc_id, font_size AS font_mode, sum(length(text)) AS n FROM b GROUP BY ALL)
        SELECT doc_id, font_mode FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, font_mode) = 1""",
    "page_origin": f"{_BASE} SELECT p.doc_id, p.page_id, f.first_y > p.height / 2 AS from_bottom FROM p JOIN f USING (doc_id, page_id)",
    "coordinate_flip": f"{_BASE} SELECT block_id, top, bottom FROM o",
    "header_footer_filter": f"{_BASE} SELECT block_id, in_margin, is_small, in_table FROM g",
    "valid_sentences": f"{_BASE} SELECT block_id, doc_id, page_id, text FROM valid",
    "page_break_identifier": f"""{_BASE},
        e AS (SELECT doc_id, page_id, arg_max(path, ord) AS last_path FROM body WHERE NOT regexp_matches(path, 'Figure|Table|Footnote') GROUP BY ALL)
        SELECT doc_id, page_id, coalesce(last_value(last_path IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_ord ROWS UNBOUNDED PRECEDING), '') AS page_break
        FROM p LEFT JOIN e USING (doc_id, page_id)""",
    "caption_blocks": f"{_BASE} SELECT block_id, path FROM o WHERE regexp_matches(path, {_q(CAPTION_PATH)})",
    "document_title": f"WITH b AS (SELECT DISTINCT * FROM blocks WHERE text IS NOT NULL) SELECT doc_id, arg_min(text, ord) AS title FROM b WHERE text <> '' AND regexp_matches(path, {_q(TITLE_PATH)}) GROUP BY doc_id",
    "lang_detect": f"SELECT block_id, {_lang('text')} AS lang FROM (SELECT DISTINCT * FROM blocks WHERE text IS NOT NULL)",
    "normalize_text": f"WITH n AS ({_NORMAL} (SELECT DISTINCT * FROM blocks WHERE text IS NOT NULL)), m AS (SELECT *, {_lang('t0')} AS l0 FROM n) SELECT block_id, {_spaced('t0', 'l0')} AS text FROM m",
    "length_divide": f"""{_SENTENCES}, k AS (SELECT block_id, t, CASE WHEN lg = 'ja_JP' THEN 300 ELSE 2000 END AS most FROM n3 WHERE t <> ''),
        q AS (SELECT *, greatest(1, ceil(length(t) / most)::INT) AS n FROM k),
        r AS (SELECT *, unnest(range(n))::INT AS chunk_no FROM q)
        SELECT block_id, chunk_no, substr(t, chunk_no * most + 1, most) || CASE WHEN chunk_no < n - 1 THEN '...' ELSE '' END AS chunk FROM r""",
    "paragraph_islands": f"""{_BASE}, l AS (SELECT *, {_lang('text')} AS lg FROM valid),
        e AS (SELECT *, {_ends('text', 'lg')} AS ends, {_HEAD} AS head FROM l),
        s AS (SELECT *, coalesce(lag(ends) OVER (PARTITION BY doc_id ORDER BY page_ord, ord), true) OR head AS starts FROM e),
        i AS (SELECT *, last_value(CASE WHEN starts THEN block_id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_ord, ord ROWS UNBOUNDED PRECEDING) AS first_block FROM s)
        SELECT doc_id, first_block, count(*) AS n_blocks, sum(length(text))::BIGINT AS n_chars, min(page_id) AS first_page, max(page_id) AS last_page FROM i GROUP BY doc_id, first_block""",
    "toc_span": f"""{_BASE},
        has AS (SELECT DISTINCT doc_id FROM o WHERE starts_with(path, '//Document/TOC') OR ({_half('lower(trim(text))')} IN ('目次', 'contents', 'table of contents', 'toc') AND font_size >= main_font_size)),
        t AS (SELECT *, regexp_matches(path, {_q(TOC_PATH)}) AS is_toc FROM g WHERE NOT in_margin AND doc_id IN (SELECT doc_id FROM has)),
        seen AS (SELECT *, max(is_toc::INT) OVER (PARTITION BY doc_id ORDER BY page_ord, ord ROWS UNBOUNDED PRECEDING) AS toc FROM t),
        fin AS (SELECT doc_id, min(CASE WHEN NOT is_toc AND toc = 1 THEN page_ord END) AS finish FROM seen GROUP BY doc_id)
        SELECT doc_id, page_id, block_id FROM seen JOIN fin USING (doc_id) WHERE is_toc AND (finish IS NULL OR page_ord <= finish)""",
    "headlines": f"""{_FLAGS}, h AS (SELECT block_id, trim(text) AS t, length(trim(text)) > 50 AND regexp_matches(trim(text), {_LONG}) AS cut FROM l WHERE {_HEAD})
        SELECT block_id, CASE WHEN cut THEN regexp_extract(t, {_LONG}, 1) ELSE t END AS headline, CASE WHEN cut THEN regexp_extract(t, {_LONG}, 2) ELSE '' END AS rest FROM h""",
    "index_regex_hist": f"{_HITS} SELECT doc_id, feature, level, rule, count(*) AS n_hits FROM hits GROUP BY ALL",
    "caption_hist": f"{_HITS}, {_CT}, {_CAPHIST} SELECT * FROM caphist",
    "adopted_index": f"{_ADOPTED} SELECT doc_id, feature, level, rule FROM adopted",
    "index_coordinates": f"{_COORDS} SELECT doc_id, feature, x0s, frequency FROM coords",
    "document_feature": f"""{_COORDS}, {_CT}, {_CAPHIST}, {_SLIDES},
        best AS (SELECT * FROM coords JOIN caphist USING (doc_id, feature) WHERE frequency > 1
          QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE feature WHEN 'japanese_legal' THEN 10 WHEN 'english_legal' THEN 20 WHEN 'general' THEN 100 END, frequency DESC) = 1)
        SELECT doc_id, CASE WHEN slide_share > 0.8 THEN 'presentation' ELSE coalesce(feature, 'other') END AS feature,
          CASE WHEN slide_share > 0.8 THEN 0 ELSE coalesce(frequency, 0) END::BIGINT AS frequency FROM votes LEFT JOIN best USING (doc_id)""",
    "slide_vote": f"WITH {_SLIDES} SELECT doc_id, slide_share, slide_share > 0.8 AS is_slides FROM votes",
    "label_extract": f"""WITH b AS (SELECT block_id, {_labels('text')} AS ls FROM (SELECT DISTINCT * FROM blocks WHERE text IS NOT NULL))
        SELECT block_id, unnest(range(len(ls)))::INT AS label_no, unnest(ls) AS label FROM b""",
    "caption_labels": f"{_BASE}, {_CAPTIONS} SELECT block_id, label, meta FROM cap",
    "nearest_caption": f"{_NEAR} SELECT content_id, upper_label, round(upper_distance, 6) AS upper_distance, lower_label, round(lower_distance, 6) AS lower_distance FROM near",
    "label_vote": f"""{_NEAR}, v AS (SELECT doc_id, kind, coalesce(upper_distance, 'inf'::DOUBLE) AS u, coalesce(lower_distance, 'inf'::DOUBLE) AS d FROM near),
        w AS (SELECT doc_id, kind, sum((u <= d)::INT)::BIGINT AS n_upper, sum((d <= u)::INT)::BIGINT AS n_lower FROM v GROUP BY doc_id, kind)
        SELECT *, n_upper > n_lower AS use_upper FROM w""",
    "nearest_text": f"""{_BASE}, {_CONTENTS},
        s AS (SELECT doc_id, font_size AS font_mode, sum(length(text)) AS n FROM b GROUP BY ALL),
        m AS (SELECT doc_id, font_mode FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, font_mode) = 1),
        bare AS (SELECT * FROM c WHERE label IS NULL OR label = ''),
        d AS (SELECT bare.content_id, g.block_id, g.ord, sqrt((bare.x0 - g.x0) ** 2 + (bare.y0 - g.top) ** 2) AS distance
          FROM bare JOIN g USING (doc_id, page_id) JOIN m USING (doc_id) WHERE NOT g.in_margin AND g.font_size >= m.font_mode
          QUALIFY row_number() OVER (PARTITION BY bare.content_id ORDER BY distance, g.ord) = 1)
        SELECT bare.content_id, d.block_id, round(d.distance, 6) AS distance FROM bare LEFT JOIN d USING (content_id)""",
    "content_geometry": f"""{_BASE}, {_CONTENTS},
        fb AS (SELECT doc_id, page_id, x0 AS fx0, top AS ft, x1 AS fx1, bottom AS fb, length(text) AS n FROM o QUALIFY row_number() OVER (PARTITION BY doc_id, page_id ORDER BY ord) = 1),
        k AS (SELECT c.content_id, c.kind = 'IMAGE' AS image, c.y0 <= p.height * 0.05 OR c.y1 >= p.height * (1 - 0.05) AS in_margin,
          abs(c.x1 - c.x0) AS w, abs(c.y1 - c.y0) AS h, abs(fb - ft) * abs(fx1 - fx0) AS area, n
          FROM c JOIN p USING (doc_id, page_id) LEFT JOIN fb USING (doc_id, page_id)),
        r AS (SELECT content_id, in_margin, image AND coalesce(abs(w * h - area) < 10 AND n > 100, false) AS covers_text,
          image AND coalesce(h / nullif(w, 0) < 1.0 / 20 OR h / nullif(w, 0) > 20, true) AS odd_aspect FROM k)
        SELECT *, NOT in_margin AND NOT covers_text AND NOT odd_aspect AS is_ok FROM r""",
    "table_normalize": r"""WITH x AS (SELECT DISTINCT * FROM cells),
        f AS (SELECT content_id, row_no, col_no, coalesce(last_value(cell_value IGNORE NULLS) OVER (PARTITION BY content_id, col_no ORDER BY row_no ROWS UNBOUNDED PRECEDING), 'nan') AS v FROM x),
        n AS (SELECT content_id, row_no, col_no, replace(replace(regexp_replace(replace(v, '_x000D_', ''), '^\s+|\s+$', '', 'g'), chr(9), ' '), chr(10), '') AS v FROM f),
        full_ AS (SELECT * FROM n WHERE v <> ''),
        rows_ AS (SELECT DISTINCT content_id, row_no FROM full_), cols_ AS (SELECT DISTINCT content_id, col_no FROM full_),
        ok AS (SELECT content_id FROM rows_ GROUP BY content_id HAVING count(*) > 1)
        SELECT content_id, row_no, col_no, nullif(v, '') AS value FROM n JOIN rows_ USING (content_id, row_no) JOIN cols_ USING (content_id, col_no) JOIN ok USING (content_id)""",
    "contents_by_label": f"""WITH {_CONTENTS}, k AS (SELECT doc_id, coalesce(replace(lower({_half('label')}), ' ', ''), '') AS label, kind, ord, content_id FROM c)
        SELECT doc_id, label, string_agg(content_id, ',' ORDER BY CASE WHEN kind = 'IMAGE' THEN 0 ELSE 1 END, ord, content_id) AS content_ids FROM k GROUP BY doc_id, label""",
    "content_urls": f"""WITH {_CONTENTS}, k AS (SELECT content_id, CASE WHEN kind = 'IMAGE' THEN 'images/' || content_id || '.jpg' ELSE 'tables/' || content_id || '.tsv' END AS s FROM c)
        SELECT content_id, 'contents/' || s AS stored_path, 'http://contents.example/' || s AS url FROM k""",
    "label_link": f"""{_LINKED} SELECT lab.block_id, lab.sent_no, cl.content_id, cl.kind, lab.label FROM lab JOIN cl USING (doc_id, label) WHERE label <> ''
        QUALIFY row_number() OVER (PARTITION BY lab.block_id, lab.sent_no, cl.path ORDER BY cl.ord, cl.content_id) = 1""",
    "unreferenced_contents": f"{_LINKED} SELECT content_id, doc_id, page_id, label FROM unref",
    "no_reference_pages": f"""{_LINKED}, once AS (SELECT * FROM unref QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY page_id, ord, content_id) = 1)
        SELECT doc_id, page_id, 'NO_REFERENCE_' || doc_id || '_' || page_id AS sentence, count(*) AS n_contents FROM once GROUP BY doc_id, page_id""",
    "pages_with_sentences": f"{_SENTENCES} SELECT DISTINCT doc_id, page_id FROM sentences",
    "pages_without_sentences": f"{_SENTENCES} SELECT DISTINCT doc_id, page_id FROM p WHERE NOT EXISTS (SELECT 1 FROM sentences s WHERE s.doc_id = p.doc_id AND s.page_id = p.page_id)",
}

_PLACE = f"CASE WHEN only_headers THEN is_headline ELSE regexp_matches(path, {_q(BODY_PATH)}) END"
_RULE = "CASE feature || rule " + " ".join(f"WHEN '{f}{no}' THEN {hit.split(' AND NOT (length')[0]}" for f, _, no, hit in _CONDITIONS) + " ELSE false END"
_REST = f"CASE WHEN length(trim(text)) > 50 AND regexp_matches(trim(text), {_LONG}) THEN regexp_extract(trim(text), {_LONG}, 2) ELSE '' END"


def _mark(after: str) -> str:
    return f"CASE WHEN {after} THEN '' ELSE '~ ' END || ' ' || text || CASE WHEN ends_with(' ' || text, '.') OR ends_with(' ' || text, ' ') THEN '' ELSE ' ' END"


SQL["paragraph_heads"] = f"""{SQL['document_feature'].rsplit('SELECT doc_id, CASE WHEN slide_share', 1)[0].rstrip()},
df AS (SELECT doc_id, CASE WHEN slide_share > 0.8 THEN 'presentation' ELSE coalesce(feature, 'other') END AS feature FROM votes LEFT JOIN best USING (doc_id)),
tr AS (SELECT df.doc_id, df.feature, adopted.rule, df.feature IN ('japanese_legal', 'presentation', 'english_legal') AS long_p, df.feature = 'presentation' AS by_page,
  df.feature = 'general' AS only_headers, string_split(coords.x0s, ',') AS x0s
  FROM df LEFT JOIN adopted USING (doc_id, feature) LEFT JOIN coords USING (doc_id, feature)),
l AS (SELECT *, {_lang('text')} AS lg FROM body),
m AS (SELECT l.*, tr.feature, tr.rule, tr.long_p, tr.by_page, tr.only_headers, tr.x0s, {_HEAD} AS is_headline,
  coalesce(lag({_ends('text', 'lg')}) OVER (PARTITION BY doc_id, page_id ORDER BY ord), false) AS after_end,
  page_id <> coalesce(lag(page_id) OVER (PARTITION BY doc_id ORDER BY page_ord, ord), 1) AS page_changed FROM l JOIN tr USING (doc_id)),
h AS (SELECT *, CASE WHEN by_page THEN page_changed ELSE ({_PLACE}) AND (NOT long_p OR coalesce(len(list_filter(x0s, lambda v: abs(v::INT - x0) < 5)), 0) > 0) AND coalesce({_RULE}, false) END AS is_head FROM m)
SELECT block_id, is_headline, page_changed, is_head, after_end,
  CASE WHEN is_headline THEN CASE WHEN is_head THEN '~  ' ELSE '' END || {_REST} WHEN is_head THEN {_mark('after_end')} WHEN NOT long_p THEN {_mark('true')} ELSE text END AS marked FROM h"""

SQL["reference_gate"] = f"""{_BASE}, r AS (SELECT doc_id, page_ord, ord, trim(text) AS t FROM g WHERE NOT in_margin AND NOT contains(coalesce(path, ''), 'Footnote')),
m AS (SELECT *, regexp_matches({_half('lower(t)')}, 'references|参考|文献|参照') AS titled,
  regexp_matches(t, '^\\[.+.+$') OR regexp_matches(t, '^\\[\\(|（][0-9]+[\\)|）].+$') OR regexp_matches(t, '^[0-9]+[\\)|）|\\.|　|\\s].+$') AS starts FROM r),
x AS (SELECT doc_id, max(CASE WHEN titled THEN (page_ord, ord) END) AS title, max(CASE WHEN starts THEN (page_ord, ord) END) AS start_ FROM m GROUP BY doc_id)
SELECT doc_id, title[1] AS title_page, coalesce(start_ IS NOT NULL AND (title IS NULL OR start_ >= title), false) AS has_start FROM x WHERE title IS NOT NULL OR start_ IS NOT NULL"""

SQL["table_tsv"] = f"""WITH n_ AS ({SQL['table_normalize']}),
lines AS (SELECT content_id, row_no, string_agg(coalesce(value, ''), chr(9) ORDER BY col_no) AS line FROM n_ GROUP BY ALL)
SELECT content_id, string_agg(line, chr(10) ORDER BY row_no) AS value FROM lines GROUP BY content_id"""

# Contents in document order, one step each. Chosen above: used from the next page on; below: at once, on the page.

def _pick(side: str, used: str) -> str:
    """Of the captions within the radius whose label is not used, the nearest; of equals the first of the page."""
    near = f"list_filter(caps, lambda c: c.{side} < 150 AND NOT list_contains({used}, c.label))"
    return f"list_sort(list_transform({near}, lambda c: {{'d': c.{side}, 'o': c.cap_ord, 'n': c.label_no, 'label': c.label, 'meta': c.meta}}))[1]"


SQL["label_assign"] = f"""{_BASE.replace('WITH b AS', 'WITH RECURSIVE b AS')}, {_CONTENTS}, {_CAPTIONS},
d AS (SELECT c.content_id, list({{'cap_ord': cap.ord, 'label_no': cap.label_no, 'label': cap.label, 'meta': cap.meta,
  'upper': sqrt((c.x0 - cap.x0) ** 2 + (c.y0 - cap.y0) ** 2), 'lower': sqrt((c.x0 - cap.x0) ** 2 + (c.y1 - cap.y0) ** 2)}}) AS caps FROM c JOIN cap USING (doc_id, page_id) GROUP BY c.content_id),
q AS (SELECT c.doc_id, c.kind, c.page_id, c.content_id, coalesce(d.caps, []) AS caps, row_number() OVER (PARTITION BY c.doc_id, c.kind ORDER BY c.page_id, c.ord, c.content_id) AS k FROM c LEFT JOIN d USING (content_id)),
w AS (SELECT doc_id, kind, 0::BIGINT AS k, NULL::INT AS page_id, NULL::VARCHAR AS content_id, []::VARCHAR[] AS used, []::VARCHAR[] AS later, []::VARCHAR[] AS low,
    NULL::STRUCT(d DOUBLE, o INT, n BIGINT, label VARCHAR, meta VARCHAR) AS up, NULL::STRUCT(d DOUBLE, o INT, n BIGINT, label VARCHAR, meta VARCHAR) AS dn FROM (SELECT DISTINCT doc_id, kind FROM q)
  UNION ALL
  SELECT doc_id, kind, k, page_id, content_id, used, CASE WHEN up IS NULL THEN later ELSE list_append(later, up.label) END, CASE WHEN dn IS NULL THEN low ELSE list_append(low, dn.label) END, up, dn
  FROM (SELECT *, {_pick('upper', 'used')} AS up, {_pick('lower', 'low')} AS dn
    FROM (SELECT q.doc_id, q.kind, q.k, q.page_id, q.content_id, q.caps, w.later,
        CASE WHEN w.page_id IS DISTINCT FROM q.page_id THEN w.later ELSE w.used END AS used, CASE WHEN w.page_id IS DISTINCT FROM q.page_id THEN []::VARCHAR[] ELSE w.low END AS low
      FROM w JOIN q ON q.doc_id = w.doc_id AND q.kind = w.kind AND q.k = w.k + 1))),
v AS (SELECT doc_id, kind, sum((coalesce(up.d, 'inf'::DOUBLE) <= coalesce(dn.d, 'inf'::DOUBLE))::INT) > sum((coalesce(dn.d, 'inf'::DOUBLE) <= coalesce(up.d, 'inf'::DOUBLE))::INT) AS above FROM w WHERE k > 0 GROUP BY doc_id, kind)
SELECT doc_id, kind, content_id, coalesce(CASE WHEN above THEN up.label ELSE dn.label END, '') AS label, coalesce(CASE WHEN above THEN up.meta ELSE dn.meta END, '') AS meta FROM w JOIN v USING (doc_id, kind) WHERE k > 0"""

from __future__ import annotations

import json

from pagewright.operators import nested

SCHEMA = "bundle_id long, doc_id long, payload string, node_pos string, extra int"


def rows(spark, payloads):
    df = spark.createDataFrame([(k, k * 10, p, "clash", 1) for k, p in enumerate(payloads)], SCHEMA)
    out = nested.nested_nodes(df).where("kind <> 'page'").select("bundle_id", "node_pos", "parent_pos", "page_id").collect()
    return {(r[0], r[1], r[2], r[3]) for r in out}


def test_positions_pages_and_files(spark):
    top = {
        "elements": [
            {"Page": 0, "Kids": [{"Page": "2", "Kids": [{"filePaths": "a.png"}]}, None, {"filePaths": ["x", None, "y"]}]},
            None,
            {"Page": 3.0, "filePaths": []},
            {"Page": True, "Kids": {"Path": "p"}},
        ]
    }
    got = rows(spark, [json.dumps(top), json.dumps({"structuredData": top})])
    want = {
        ("0", "", 1), ("0.0", "0", 3), ("0.0.0", "0.0", 3), ("0.0.0#0", "0.0.0", 3), ("0.2", "0", 1), ("0.2#0", "0.2", 1), ("0.2#2", "0.2", 1),
        ("2", "", 4), ("3", "", -1), ("3.0", "3", -1),
    }
    assert got == {(b, *w) for b in (0, 1) for w in want}


def test_odd_payloads_give_no_rows_and_no_failure(spark):
    assert rows(spark, [None, "", "<html>", "[1]", '"x"', "{}", '{"elements": null}', '{"elements": [NaN]}', '{"elements": 3}']) == set()
    assert nested.nested_nodes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_count_once_and_surrogates_survive(spark):
    p = '{"elements": [{"Text": "\\ud800x", "Bounds": [1, 2]}]}'
    df = spark.createDataFrame([(1, 1, p, "", 0)] * 3, SCHEMA)
    r = nested.nested_nodes(df).collect()
    assert len(r) == 1 and r[0].text == "�x" and r[0].x0 is None


def test_depth_beyond_the_parser(spark):
    n = 60_000
    deep = '{"elements": [' + '{"Kids": [' * n + "{}" + "]}" * n + "]}"
    top = nested.parse_payload(deep)
    assert top is not None and sum(1 for _ in zip(range(5), nested.walk(top))) == 5
    assert nested._deep_loads('{"a": [1, {"b": "]"}, []], "c": {}}') == {"a": [1, {"b": "]"}, []], "c": {}}
    assert nested.parse_payload('{"elements": [' + '{"Kids": [' * n) is None
    while isinstance(top, dict) and top:  # unlink level by level, as freeing it at once would recurse
        top = next(iter(top.values()))
        top = top[0] if isinstance(top, list) and top else None


def test_truncated_label_is_the_parent(spark, data):
    n = nested.nested_nodes(spark.read.parquet(f"{data}/bundles.parquet")).where("kind <> 'page'")
    kids = n.where("parent_pos <> ''").select("bundle_id", "parent_pos").dropDuplicates()
    have = n.where("kind = 'element'").selectExpr("bundle_id", "node_pos as parent_pos")
    assert kids.join(have, ["bundle_id", "parent_pos"], "left_anti").count() == 0


def test_schema_tables_count_bundles_exactly(spark):
    top = json.dumps({"elements": [{"Page": 0, "Path": "//Document/P", "Text": "a"}, {"Page": 0, "Path": "//Document/P[2]"}]})
    df = spark.createDataFrame([(k, k, top, "", 1) for k in range(3000)], SCHEMA)
    got = nested.schema_tables(nested.nested_nodes(df)).collect()
    assert [(r["n_nodes"], r["n_bundles"], r["n_texts"]) for r in got] == [(6000, 3000, 3000)]

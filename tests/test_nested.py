import datetime as dt
import json

from lodestrata.operators.nested import SUBTYPES, artifacts_table, latest_reports, leaves, objects, opened, routed, subtype_table

SCHEMA = "report_id long, received_at timestamp_ntz, body string, entity string, node string"


def run(spark, *rows):
    out = [(i, dt.datetime(2031, 1, 1, h), b if isinstance(b, (str, type(None))) else json.dumps(b), "e", "n") for i, h, b in rows]
    nodes = objects(latest_reports(spark.createDataFrame(out, SCHEMA)))
    return sorted(tuple(r) for r in leaves(nodes).collect()), nodes


SYFT = {"artifacts": [None, {"locations": [None, {"path": "/a"}, {"path": None}], "metadata": {"dependencies": {"x": "^1", "y": None}}}, {"locations": {"path": "/b"}, "metadata": {"dependencies": [{"name": "z", "range": "1"}, {"name": "z", "range": "1"}, "w", None]}}]}
WANT = [("dependency", "artifacts[1]", "x", "^1"), ("dependency", "artifacts[1]", "y", ""), ("dependency", "artifacts[2]", "w", ""), ("dependency", "artifacts[2]", "z", "1"), ("location", "artifacts[1]", "1", "/a"), ("location", "artifacts[2]", "0", "/b")]


def test_shapes(spark):
    got, nodes = run(spark, (1, 0, SYFT))
    assert got == [(1, *w) for w in WANT]
    assert [r.state for r in artifacts_table(nodes).orderBy("path").collect()][1:] == ["locations/list/dependencies/object", "locations/object/dependencies/list"]


def test_wrapped_reports_count_as_themselves(spark):
    deep = json.dumps({"a": 1, "b": [{"c": json.dumps({"payload": SYFT})}]})
    got, _ = run(spark, (1, 0, {"report": SYFT}), (2, 0, json.dumps(json.dumps(SYFT))), (3, 0, "﻿" + json.dumps(SYFT)), (4, 0, deep))
    assert got == sorted((i, *w) for i in (1, 2, 3, 4) for w in WANT)
    assert opened("[" * 5000) is None and opened('{"x": "{broken"}') is None


def test_latest_readable_delivery(spark):
    other = {"runs": {"results": [{"message": "m"}, {"message": {"text": None}}, None, {"message": {"text": "t"}}, {"message": 5}]}}
    got, _ = run(spark, (1, 0, SYFT), (1, 1, other), (1, 2, '{"artifacts": ['), (1, 3, None), (1, 4, ""), (1, 5, "null"), (2, 0, "text"), (3, 0, {"artifacts": None, "runs": None}))
    assert got == [(1, "message", "runs[0].results[0]", "", "m"), (1, "message", "runs[0].results[3]", "", "t"), (1, "message", "runs[0].results[4]", "", "5")]


def test_empty(spark):
    assert latest_reports(spark.createDataFrame([], SCHEMA)).count() == 0


def test_subtypes_are_the_leaves_and_a_body_is_opened_once(spark):
    rows = [(1, dt.datetime(2031, 1, 1), json.dumps({"wrapped": SYFT}), "e", "n"), (2, dt.datetime(2031, 1, 1), json.dumps({"runs": [{"results": [{"message": "m"}, {"message": {"text": "t"}}]}]}), "e", "n")]
    nodes = objects(latest_reports(spark.createDataFrame(rows, SCHEMA)))
    every = leaves(nodes)
    assert every._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    apart = sorted(tuple(r) for s in SUBTYPES for r in subtype_table(routed(nodes), s).collect())
    assert apart == sorted(tuple(r) for r in every.collect()) and len(apart) == len(WANT) + 2

import json

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import inventory, stored


def test_positions_of_hot_groups_ties_and_nulls(spark):
    rows = [("hot", i % 50, f"k{i}") for i in range(600)] + [(None, 1, "x"), (None, 0, "y"), ("one", None, "z"), ("one", 5, "w")]
    df = spark.createDataFrame(rows, "g string, o int, k string")
    got = {(r.g, r.k): r.position for r in stored.positions(df, ["g"], [F.col("o"), F.col("k")], ["k"]).collect()}
    for g in {r[0] for r in rows}:
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[g, r[2]] for r in want] == list(range(len(want)))
    assert stored.positions(df.limit(0), ["g"], [F.col("o")], ["k"]).count() == 0


def test_finding_size():
    good = {"scanner": "s", "rule_id": "r", "file": "f", "line": 3, "ü": [1.5, None, {"a": "b"}]}
    assert stored._size(json.dumps(good)) == len(json.dumps(good, sort_keys=True, separators=(",", ":")))
    deep = None
    for _ in range(9):
        deep = [deep]
    for bad in ({"line": 0}, {"line": True}, {"line": "1"}, {"file": ""}, {"rule_id": None}, {"scanner": 3}, {"x": "y" * 70000}, {"x": [0] * 5000}, {"x": deep}, {"x": float("inf")}):
        assert stored._size(json.dumps(good | bad)) is None
    assert stored._size(json.dumps({**good, "rule_id": None, "title": "t"})) and stored._size("[1]") is None and stored._size("{") is None


def test_labels(spark):
    df = spark.createDataFrame([("parsed", "npm", "d", "p"), ("failed", "npm", "d", "p"), ("bounded-omission", "npm", "d", "p"), ("ignored", "npm", "d", "p"), ("parsed", None, "d", "p"), ("parsed", "npm", None, "p"), (None, "npm", "d", "p")], "a string, e string, d string, p string")
    assert [r[0] for r in df.select(stored.input_outcome(F.col("a"), F.col("e"), F.col("d"), F.col("p"))).collect()] == ["complete", "failed", "partial", "unknown", "unknown", "unknown", "unknown"]
    m = spark.createDataFrame([(1.23456, 5, 9), (0.0, None, 9), (2.0, 9, 9), (-1.0, 1, 2), (1801.0, 1, 2), (float("nan"), 1, 2), (1.0, 1, (1 << 40) + 1)], "s double, b long, a long")
    got = [r[0] and tuple(r[0]) for r in m.select(stored.component_metric(F.col("s"), F.col("b"), F.col("a"))).collect()]
    assert got == [(1.235, "partial", 9), (0.0, "unavailable", None), (2.0, "unavailable", None), None, None, None, (1.0, "unavailable", None)]
    c = spark.createDataFrame([("", "SAST", "x"), (None, None, "cve"), ("odd", "sast", "cve"), (None, None, None)], "c string, t string, s string")
    assert [r[0] for r in c.select(stored.legacy_gate_category(F.col("c"), F.col("t"), F.col("s"))).collect()] == ["sast", "cve", "other", "other"]
    s = spark.createDataFrame([("high", "t", "f"), (None, None, ""), ("", "t", None)], "s string, t string, f string")
    assert [r[0] for r in s.select(stored.issue_summary(F.col("s"), F.col("t"), F.col("f"))).collect()] == ["[HIGH] t — f", "[UNKNOWN] Security Finding", "[UNKNOWN] t"]


def test_checks(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "path string")
    assert stored.refuse_beyond(df, 3, "rows").count() == 3
    with pytest.raises(Exception, match="rows exceed 2"):
        stored.refuse_beyond(df, 2, "rows").collect()
    assert [r.path for r in stored.in_both(df, df.where("path = 'b'")).collect()] == ["b"]
    rules = spark.createDataFrame([(1, "fail"), (2, "warn"), (3, "ignore")], "rule_no int, action string")
    assert stored.parity(rules, rules).count() == 0
    assert [tuple(r) for r in stored.parity(rules, rules.where("rule_no <> 2")).collect()] == [(2, "warn", True, False)]
    f = spark.createDataFrame([("x", 40, "gitleaks", "a"), ("x", None, "gitleaks", "a"), ("y", 30, "semgrep", "b")], "finding_id string, age_days int, scanner string, file string")
    assert stored.aged(f).count() == 1 and [tuple(r) for r in stored.secrets_check(f).collect()] == [(2, 1)] and [tuple(r) for r in stored.duplicate_ids(f).collect()] == [("x", 2)]
    assert stored.of_id(f, "finding_id", "y").count() == 1


def test_variant_overlaps(spark):
    rows = [("l", "a", ["r"], [], "python_version < '3'", "/0"), ("l", "a", ["r"], [], "python_version >= '3'", "/1"), ("l", "a", ["r"], None, "os_name == 'nt'", "/2"), ("l", "b", [], [], None, "/3"), ("l", "b", [], [], None, "/4"), ("l", "b", ["x"], [], None, "/5"), ("m", "b", [], [], None, "/3")]
    df = spark.createDataFrame(rows, "path string, name string, scopes array<string>, extras array<string>, marker string, locator string")
    assert sorted((r.name, r.first, r.second) for r in inventory.variant_overlaps(df).collect()) == [("a", "/0", "/2"), ("a", "/1", "/2"), ("b", "/3", "/4")]


def test_ordered_digest_is_a_tree_over_the_order(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(stored, "BLOCK", 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [("big", i) for i in range(29)] + [("small", 1), ("small", 0), (None, 7)]
    df = spark.createDataFrame(rows, "g string, o int")
    got = {r.g: (r.n, r.digest) for r in stored.ordered_digest(df, ["g"], [F.col("o")], ["o"]).collect()}
    for g in ("big", "small", None):
        level = [sha(f'{{"o":{o}}}') for o in sorted(o for x, o in rows if x == g)]
        n, first = len(level), True
        while first or len(level) > 1:
            cut = [level[i : i + 3] for i in range(0, len(level), 3)]
            level = [c[0] if len(c) == 1 and not first else sha("".join(c)) for c in cut]
            first = False
        assert got[g] == (n, level[0])
    other = stored.ordered_digest(df, ["g"], [-F.col("o")], ["o"]).where("g = 'big'").first()
    assert other.digest != got["big"][1]
    assert stored.ordered_digest(df.limit(0), ["g"], [F.col("o")], ["o"]).count() == 0

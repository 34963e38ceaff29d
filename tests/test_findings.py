import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import vocab
from lodestrata.operators import findings as op
from lodestrata.plans import findings as plans

RAW = "finding_id string, scan_id string, rule_id string, file string, line int, severity string, category string, trend string, scan_timestamp timestamp_ntz, payload string, ingested_at timestamp_ntz, project string, node string"
ROW = "scan_id string, finding_id string, rule_id string, file string, line int, severity string, category string, project string"


def t(n):
    return dt.datetime(2031, 1, 1) + dt.timedelta(days=n)


def rows(spark, *items):
    base = {"scan_id": "s", "finding_id": "f", "rule_id": "r", "file": "a", "line": 1, "severity": "high", "category": "sast", "project": "p"}
    return spark.createDataFrame([tuple((base | i).values()) for i in items], ROW)


def test_cleaning(spark):
    raw = [
        (" A ", "s", " R ", "./x", 1, "HIGH ", "SAST", "new", t(0), None, t(0), "p", "q"), ("a", "s", "r", "x", 1, "low", None, "new", t(0), None, t(1), "p", "q"),
        (None, "s", None, None, None, None, "", None, None, None, None, "p", "q"), ("b", None, "r", "x", 1, "low", "x", "new", t(0), None, t(1), "p", "q"),
    ]
    got = {r.severity: (r.scan_id, r.rule_id, r.file, r.line, r.category) for r in op.cleaned(spark.createDataFrame(raw, RAW)).collect()}
    assert got == {"low": ("s", "r", "x", 1, ""), "": ("s", "", "", 0, "")}
    assert op.cleaned(spark.createDataFrame([], RAW)).count() == 0


def test_suppression_takes_the_first_active_rule(spark):
    rules = [op.IgnoreRule(rule_id="z"), op.IgnoreRule(rule_id="r", until="2030-01-01"), op.IgnoreRule(file_path="src/*.py", permanent=True), op.IgnoreRule(message="Found", until="2032-01-01"), op.IgnoreRule(cve_id="C", permanent=True)]
    df = spark.createDataFrame([("r", "src/a/b.py", "x", None), ("r", "a", "it was FOUND", "C"), ("r", "a", None, "C"), ("r", None, None, None), ("z", "srcx.py", "", "")], "rule_id string, file string, message string, cve_id string")
    hit = op.suppression(rules, F.to_timestamp(F.lit("2031-01-01")), {c: F.col(c) for c in df.columns})
    assert [r[0] for r in df.select(hit).collect()] == [2, 3, 4, None, None]
    assert [r[0] for r in df.select(op.suppression([], F.lit(None), {})).collect()] == [None] * 5


def test_tracking(spark):
    stamp = "finding_id string, scan_timestamp timestamp_ntz"
    now = spark.createDataFrame([("a", t(10)), ("b", t(10)), ("b", t(10)), ("c", t(10))], stamp)
    old = spark.createDataFrame([("a", t(1), t(0)), ("a", t(5), t(3)), ("d", t(5), t(3)), ("c", None, None), ("d", t(5), t(3))], stamp + ", first_seen timestamp_ntz")
    got = sorted((r.finding_id, r.trend, r.age_days) for r in op.tracked(now, old).collect())
    assert got == [("a", "unchanged", 7), ("b", "new", 0), ("b", "new", 0), ("c", "unchanged", 0)]
    assert [r.finding_id for r in op.resolved(now, old).collect()] == ["d"]


def test_baseline_matches_exactly_or_without_the_line(spark):
    base = rows(spark, {"file": "./a", "line": 5}, {"rule_id": "q", "file": "/src/b", "line": 1})
    new = rows(spark, {"finding_id": "1", "file": "a", "line": 9}, {"finding_id": "2", "rule_id": "q", "file": "b"}, {"finding_id": "3", "rule_id": "q", "file": "b", "line": 2}, {"finding_id": "4", "rule_id": None, "file": None, "line": None})
    assert sorted(r.finding_id for r in op.not_in_baseline(new, base).collect()) == ["3", "4"]


def test_policy_levels(spark):
    f = rows(spark, *[{"severity": "high", "category": c} for c in ("container", "image", "sast")], {"severity": "low", "category": ""})
    rules = [(1, None, None, 3, "fail"), (2, None, None, 4, "fail"), (3, "high", None, 2, "warn"), (4, "high", "container_images", 1, "fail"), (5, None, "sast", 0, "ignore"), (6, None, "sast", None, "fail"), (7, "critical", None, 0, "fail")]
    got = sorted(tuple(r) for r in op.violations(f, spark.createDataFrame(rules, "rule_no int, severity string, category string, max_count int, action string")).collect())
    assert got == [(1, "fail", 4, 3), (3, "warn", 3, 2), (4, "fail", 2, 1), (6, "fail", 1, 0)]


def test_snapshots_are_dense(spark):
    f = rows(spark, {"severity": "HIGH", "category": "code", "finding_id": "x"}, {"severity": "?", "category": None, "finding_id": "y"})
    got = {(r.category, r.severity): r.n for r in op.snapshot(f).collect()}
    assert len(got) == 8 * 6 and got[None, None] == 2 and got["sast", "high"] == 1 and got["other", "unknown"] == 1 and got["iac", "low"] == 0
    got = {(r.category, r.cohort, r.severity): r.n for r in op.cohorts(f, spark.createDataFrame([("y",), ("y",)], "finding_id string")).collect()}
    assert len(got) == 7 * 2 * 5 and got["sast", "new", "high"] == 1 and got["other", "existing", "unknown"] == 1 and sum(got.values()) == 2
    assert sum(r.n for r in op.snapshot(f.limit(0)).collect()) == 0


def test_controls(spark):
    c = spark.createDataFrame([("A", ["sast", "iac"]), ("B", ["cve"])], "control_id string, categories array<string>")
    f = rows(spark, {"category": "sast"}, {"category": "IAC "}, {"category": "odd"}, {"category": None})
    assert {r.control_id: r.n for r in op.control_coverage(f, c).collect()} == {"A": 2, "B": 0}
    assert {r.category: r.n for r in op.unmapped(f, c).collect()} == {"odd": 1, "": 1}


def test_issues_comments_scope_and_repeats(spark):
    from lodestrata.functions.ids import issue_fingerprint

    f = rows(spark, {"finding_id": "1"}, {"finding_id": "2", "severity": "critical"}, {"finding_id": "3", "file": "b/c", "severity": "low"}, {"finding_id": "4", "file": "bc/d"})
    known = spark.createDataFrame([("r", "bc/d"), ("r", "gone")], "r string, f string").select(issue_fingerprint(F.col("r"), F.col("f")).alias("fingerprint"))
    assert sorted((r.action, r.priority or "") for r in op.issue_plan(f, known).collect()) == [("close", ""), ("create", "Highest"), ("skip", "High")]
    touched = op.on_changed_lines(f, spark.createDataFrame([("a", 1), ("a", 1), ("b/c", 2)], "file string, line int"))
    assert [(r.file, r.first_line, r.n, r.body) for r in op.comments(touched).collect()] == [("a", 1, 2, "- r (line 1)\n- r (line 1)")]
    units = spark.createDataFrame([("b",), ("b/c",)], "unit string")
    assert [r.finding_id for r in op.in_scope(f, units).collect()] == ["3"]
    assert op.in_scope(f, spark.createDataFrame([(".",)], "unit string")).count() == 4
    assert [r.n for r in op.repeated(f).collect()] == [2]


def test_budget_fold_discards_without_cost(spark):
    df = spark.createDataFrame([("k", 1, 5), ("k", 2, 9), ("k", 3, 5), ("k", 4, 1), ("e", 1, 99)], "g string, ord int, size int")
    assert sorted((r.g, r.ord, r.kept) for r in op.budget_fold(df, 10, "g").collect()) == [("e", 1, False), ("k", 1, True), ("k", 2, False), ("k", 3, True), ("k", 4, False)]


def test_budget_fold_query_gives_every_rule_a_verdict(spark, tmp_path):
    sizes = {"a": [3] * 5 + [30] + [1] * 30, "b": [26, 25, 1], "c": [1]}
    scans, found = [], []
    for project, each in sizes.items():
        scans += [(f"{project}0", t(0), project), (f"{project}1", t(5), f" {project.upper()} ")]
        found += [(f"{project}1", f"r{k:02}", i) for k, n in enumerate(each) for i in range(n)]
        found += [(f"{project}0", "old", 1)]
    spark.createDataFrame(scans, "scan_id string, scan_timestamp timestamp_ntz, project string").write.parquet(f"{tmp_path}/scan_records.parquet")
    df = spark.createDataFrame([(s, r, f"{r}-{i}", i, t(9)) for s, r, i in found], "scan_id string, rule_id string, finding_id string, line int, ingested_at timestamp_ntz")
    missing = [F.lit(None).cast("string").alias(c) for c in ("severity", "category", "trend", "payload")]
    df.select("*", F.lit("f").alias("file"), F.col("ingested_at").alias("scan_timestamp"), *missing).write.parquet(f"{tmp_path}/findings.parquet")
    want = set()
    for project, each in sizes.items():
        used = 0
        for k, n in enumerate(each, 1):
            kept = used + n <= 25
            used += n * kept
            want.add((project, k, kept))
    got = [tuple(r) for r in plans.budget_fold(spark, str(tmp_path)).collect()]
    assert len(got) == 40 and set(got) == want


def test_order_and_overdue(spark):
    f = rows(spark, *[{"finding_id": str(i), "severity": s} for i, s in enumerate(["low", "weird", None, "CRITICAL", "high", "low"])])
    assert [r.finding_id for r in op.in_display_order(f, ["finding_id"]).collect()] == ["3", "4", "0", "2", "5", "1"]
    assert sorted(r.finding_id for r in op.by_severity(f, "medium").collect()) == ["3", "4"] and op.by_severity(f, "nonsense").count() == 6
    df = spark.createDataFrame([(t(0), 1), (t(-1), 1), (None, 1)], "assigned_at timestamp_ntz, sla_days int")
    assert op.overdue(df, F.to_timestamp(F.lit("2031-01-02 00:00:00"))).count() == 1


@pytest.mark.parametrize("value,want", [("Hardcoded-Secret", ("secrets", "hardcoded-secret", "hardcoded-secret", "secrets")), (None, ("unknown", "", None, "other")), ("container", ("container", "dependency_scanning", "container_images", "container_images"))])
def test_vocabularies_stay_apart(spark, value, want):
    df = spark.createDataFrame([(value,)], "c string")
    c = F.col("c")
    row = df.select(vocab.stored_category(F.coalesce(c, F.lit(""))), vocab.compliance_category(c), vocab.policy_category(c), vocab.gate_category(c)).first()
    assert tuple(row) == want


def test_what_one_project_knows_is_new_to_another(spark):
    cols = "project string, finding_id string, rule_id string, file string, line int, severity string, category string"
    now = spark.createDataFrame([("p", "f", "r", "a.py", 3, "high", "sast"), ("q", "f", "r", "a.py", 3, "high", "sast")], cols)
    before = now.where("project = 'p'")
    assert [r.project for r in op.not_in_baseline(now, before, ["project"]).collect()] == ["q"]
    assert {(r.cohort, r.n) for r in op.cohorts(now, before, ["project"]).where("n > 0").collect()} == {("new", 1), ("existing", 1)}
    assert [r.project for r in op.on_changed_lines(now, before, ["project"]).collect()] == ["p"]
    known = before.select("project", op.issue_fingerprint(F.col("rule_id"), F.col("file")).alias("fingerprint"))
    assert {(r.project, r.action) for r in op.issue_plan(now, known, ["project"]).collect()} == {("p", "skip"), ("q", "create")}

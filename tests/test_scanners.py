import json

from pyspark.sql import functions as F

from lodestrata.operators import reports as R
from lodestrata.sources import sbom, scanners as S


def frame(spark, *bodies):
    return spark.createDataFrame([(f"p{i}", b if isinstance(b, (str, type(None))) else json.dumps(b)) for i, b in enumerate(bodies)], "path string, body string")


def got(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("path", "ord").collect()]


def test_gitleaks(spark):
    df = frame(spark, [{"RuleID": "aws", "File": "a.py", "StartLine": 3, "Match": "AKIA"}, {}], "no", None, {"x": 1})
    assert got(S.gitleaks(df.limit(1)), "rule_id", "file", "line", "severity", "category") == [("aws", "a.py", 3, "critical", "hardcoded-secret"), ("exposed-secret", "unknown", 1, "critical", "hardcoded-secret")]
    assert sorted(tuple(r) for r in S.refused(df, None).collect()) == [("p1", "invalid-json"), ("p2", "invalid-json"), ("p3", "missing-list")]


def test_semgrep(spark):
    r = lambda i, sev, meta, msg="m": {"check_id": i, "path": "a", "start": {"line": 2}, "extra": {"severity": sev, "message": msg, "metadata": meta}}
    df = frame(spark, {"results": [r("a", "ERROR", {"cwe": "1"}), r("b", "INFO", {"cwe": ["1"]}), r("c", "WARNING", {}), r("d", "WARNING", {}, "SQL thing"), r("pytest.*x", "ERROR", {"cwe": "1"}), r("e", "ERROR", {"cwe": "1", "category": "best practice"}), r("f", "ERROR", {"cwe": "1", "security-severity": "LOW"}), r("g", "INFO", {}, "sql")], "errors": [{"level": "warn", "type": "T"}, {"level": "error", "type": "T"}]})
    assert got(S.semgrep(df), "rule_id", "severity", "line") == [("a", "high", 2), ("b", "medium", 2), ("d", "medium", 2), ("f", "low", 2)]
    assert sorted((r.type, r.fatal, r.n) for r in S.semgrep_errors(df).collect()) == [("T", False, 1), ("T", True, 1)]


def test_kics_and_grype(spark):
    q = lambda n, s, **k: {"query_name": n, "severity": s, "description": "d", **k}
    df = frame(spark, {"queries": [q("Open bucket", "HIGH", files=[{"file_name": "a.tf", "line": 4}, {"file": "b.tf"}]), q("Naming convention", "HIGH", files=[{}]), q("x", "INFO", files=[{}]), q("y", "info", results=[{"file": "c"}]), q("z", "LOW", files=[], results=None)]})
    assert got(S.kics(df), "rule_id", "file", "line", "severity") == [("Open bucket", "a.tf", 4, "high"), ("Open bucket", "b.tf", 1, "high"), ("y", "c", 1, "medium")]
    m = {"vulnerability": {"id": "CVE-1", "severity": "Negligible", "fix": {"versions": ["2.0"]}, "cvss": [{"metrics": {"baseScore": 7.5}}]}, "artifact": {"name": "a", "version": "1", "locations": [{"path": None, "accessPath": "/x"}]}}
    df = frame(spark, {"matches": [m, {"vulnerability": {}, "artifact": {}}]})
    assert got(S.grype(df), "rule_id", "file", "severity") == [("CVE-1", "/x", "negligible"), ("unknown", "dependency: unknown", "medium")]
    assert got(S.grype(df, image=True), "rule_id", "severity") == [("CVE-1:a@1", "medium"), ("unknown:unknown@unknown", "medium")]
    assert [(r.package, r.fixed_version, r.cvss_score) for r in S.fixable(df).collect()] == [("a", "2.0", 7.5)]


def test_stored_shapes(spark):
    v2 = {"vulnerabilities": [{"rule_id": "r", "file": "./a", "line": 1}], "scan_record": {"scan_id": "s", "finding_count": 1, "scanner_versions": {"x": "1"}}, "scan_records": [{"scan_id": "t"}]}
    df = frame(spark, v2, {"issues": [{"ruleId": "r", "location": {"file": {"path": "/src/b"}, "start_line": 2}, "scanner": {"id": "q"}}]}, [{"check_id": "c", "location": {"path": "c"}}, 5], "x", {"issues": []})
    assert got(S.stored(df), "rule_id", "file", "line", "scanner") == [("r", "a", 1, None), ("r", "b", 2, "q"), ("c", "c", 0, None)]
    assert [(r.scan_id, r.finding_count, r.scanner_versions) for r in S.scan_records(df).orderBy("path", "ord").collect()] == [("s", 1, {"x": "1"}), ("t", None, None)]


def test_report_formats(spark):
    g = {"vulnerabilities": [{"id": "i", "name": "n", "severity": "High", "location": {"file": "a", "start_line": 2}, "identifiers": [{"type": "x", "value": ""}, {"type": "CVE", "value": "CVE-1"}]}, {"id": "j"}]}
    assert got(S.gitlab(frame(spark, g)), "rule_id", "cve_id", "file") == [("CVE-1", "CVE-1", "a"), ("j", None, "unknown")]
    s = {"runs": [{"results": [{"ruleId": "r", "level": "error", "message": {"text": "t"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "a"}, "region": {"startLine": 3}}}]}, {"ruleId": "no location"}]}, {"results": None}]}
    assert got(S.sarif(frame(spark, s)), "rule_id", "severity", "file", "line") == [("r", "high", "a", 3)]


def test_fixed_versions_and_paths(spark):
    df = spark.createDataFrame([("Upgrade to version 1.2.3 now",), ("needs >= 2.0",), ("Version 3.1 or later",), ("none",), (None,)], "s string")
    assert [r[0] for r in df.select(S.fixed_version(F.col("s"))).collect()] == ["1.2.3", "2.0", "3.1", "", ""]
    assert sorted(r.path for r in S.path_list(spark.createDataFrame([("a\x00b c\x00\x00",), (None,)], "body string")).collect()) == ["a", "b c"]


def test_unified_diff(spark):
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +5,3 @@ f\n a\n-b\n+c\n+d\n\\ No newline\n e\n+f\ndiff --git a/y b/y\n@@ broken\n+z\n"
    df = spark.createDataFrame([(1, diff), (2, ""), (3, None)], "diff_id int, body string")
    assert sorted((r.diff_id, r.file, r.line) for r in S.changed_lines(df).collect()) == [(1, "x", 6), (1, "x", 7), (1, "x", 9), (1, "y", 1)]


def test_detectors(spark):
    php = "<?php\n$x = $_GET['a'];\nmysql_query('SELECT');\nsystem($_POST['c']);\n"
    df = spark.createDataFrame([("a.php", php), ("b.php", "echo 1;"), ("c.php", None)], "file string, content string")
    assert sorted((r.type, r.severity, r.line) for r in S.detect(df).collect()) == [("Command Injection", "CRITICAL", 4), ("SQL Injection", "CRITICAL", 1), ("SQL Injection", "ERROR", 3)]


def test_sbom(spark):
    c = lambda **k: {"bom-ref": "r", **k}
    body = {"components": [c(name="a", version="1", purl="pkg:npm/a@1"), c(group="@s", name="b", version="2", purl="pkg:npm/%40s/b@2"), c(name="a", version="2", purl="pkg:npm/a@1"), c(name="z", version="1", purl="pkg:npm/a@1"), c(name="n"), c(name="a", version="1", purl="pkg:npm/a@1")]}
    df = frame(spark, body, None, "{")
    assert sorted((r.name, r.problem or "") for r in sbom.components(df).collect()) == [("@s/b", ""), ("a", ""), ("a", ""), ("a", "version-contradicts-purl"), ("n", "no-purl"), ("z", "name-contradicts-purl")]
    assert sorted((r.purl, r.seen) for r in sbom.imported(df).collect()) == [("pkg:npm/%40s/b@2", 1), ("pkg:npm/a@1", 2)]


def test_syft_receipt(spark):
    body = json.dumps({"artifacts": [{"id": "1", "name": "a", "locations": [{"path": "/x/lock"}]}, {"id": "2", "name": "b", "locations": [{"path": "/other"}]}], "artifactRelationships": [{"parent": "1", "child": "2", "type": "dependency-of"}, {"parent": "1", "child": "2", "type": "contains"}]})
    raw = spark.createDataFrame([(7, None, body)], "report_id long, received_at timestamp, body string")
    candidates, edges = S.syft_receipt(raw, spark.createDataFrame([("x/lock", "h")], "file string, sha256 string"))
    assert [(r.name, r.file, r.sha256) for r in candidates.collect()] == [("a", "x/lock", "h")]
    assert [tuple(r) for r in edges.collect()] == [(7, "2", "1")]


def test_reports(spark):
    f = spark.createDataFrame([("i", "r", "a.py", 0, "HIGH", "secret", "m", 1), ("j", "r", "dependency: x", 2, "weird", "", None, 0)], "finding_id string, rule_id string, file string, line int, severity string, category string, message string, ord int")
    a, b = [json.loads(r.result) for r in R.sarif_results(f).orderBy("finding_id").collect()]
    assert a["locations"][0]["physicalLocation"]["region"]["startLine"] == 1 and a["level"] == "error" and a["message"]["text"] == "m"
    assert b["locations"][0]["logicalLocations"][0]["fullyQualifiedName"] == "dependency: x" and b["level"] == "warning"
    assert [tuple(r) for r in R.sarif_rules(f, F.col("ord")).collect()] == [("r", "weird", None)]
    v = json.loads(R.vulnerability_rows(f).where("finding_id = 'i'").first().vulnerability)
    assert (v["category"], v["severity"], v["location"]) == ("secrets", "high", {"file": "a.py", "start_line": 0})
    assert "fix_type" not in json.loads(R.stored_rows(f.withColumn("fix_type", F.lit(""))).first().finding)
    up = R.upserted(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, ord int, v string"), spark.createDataFrame([("a", 0, "n"), ("c", 1, "p"), ("c", 2, "q")], "k string, ord int, v string"), "k", "ord")
    assert sorted(tuple(r) for r in up.collect()) == [("a", 0, "n"), ("b", 1, "y"), ("c", 2, "q")]
    assert R.merged([f.limit(1), f.select("finding_id").limit(1)]).count() == 2


def test_version_bumps(spark):
    rows = [("pypi", "a==1.0  # c", "a"), ("pypi", "ab==1.0", "a"), ("npm", '  "a": "^1.0.0",', "a"), ("npm", '  "@s/a": "1.0.0"', "@s/a"), ("golang", "\tx.y/a v1.0.0 // indirect", "x.y/a"), ("gem", "gem 'a', '1.0'", "a")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, e string, l string, p string")
    out = {}
    for e in {r[0] for r in rows}:
        out |= {r.i: r.o for r in df.where(F.col("e") == e).select("i", R.bumped(F.col("l"), e, F.col("p"), F.lit("2.0")).alias("o")).collect()}
    assert [out[i] for i in range(6)] == ["a>=2.0  # c", "ab==1.0", '  "a": "^2.0",', '  "@s/a": "2.0"', "\tx.y/a v2.0 // indirect", "gem 'a', '~> 2.0'"]


def test_quality_marks_are_both_lists_whole(spark):
    from lodestrata.sources import scanners as sc

    for mark in ("unused container instruction", "dockerfile use json array for run instructions", "terraform output tag", "code pattern", "pattern", "best practice", "liveness probe", "runs as root", "user in dockerfile", "indentation"):
        assert mark in sc.QUALITY_MARKS
    assert len([x for x in sc.QUALITY_QUERIES.split(";") if x.strip()]) == 63 and len(sc.QUALITY_TEXTS.split(";")) == 30
    named = lambda n: {"query_name": n, "severity": "HIGH", "description": "d", "files": [{"file_name": "a", "line": 1}]}
    body = json.dumps({"queries": [named("Liveness Probe Is Not Defined"), named("Service Runs As Root"), named("Terraform  Output Tag"), named("Open Port")]})
    got = sc.kics(spark.createDataFrame([("r", body)], "path string, body string")).collect()
    assert [r.rule_id for r in got] == ["Terraform  Output Tag", "Open Port"]


def test_remediation_and_compliance_shapes(spark):
    from lodestrata.sources import scanners as sc

    frame = lambda *bodies: spark.createDataFrame([(str(i), json.dumps(b)) for i, b in enumerate(bodies)], "path string, body string")
    r = sc.remediation(frame([{"RuleID": "k"}, {}]), "gitleaks").orderBy("ord").collect()
    assert [(x.fix_type, x.fix_complexity, x.effort_mins, x.affected_symbol) for x in r] == [("code_change", "moderate", 30, "k"), ("code_change", "moderate", 30, "secret")]
    assert json.loads(r[0].context["remediation_steps"]) == sc.SECRET_STEPS and r[0].context["secret_kind"] == '"k"'
    r = sc.remediation(frame({"results": [{"check_id": "a.b.c", "extra": {"fix": "f", "metadata": {"cwe": ["1"], "owasp": [], "references": ""}}}, {"check_id": "x"}]}), "semgrep").orderBy("ord").collect()
    assert [(x.fix_complexity, x.effort_mins, x.affected_symbol) for x in r] == [("trivial", 5, "c"), ("moderate", 30, "x")]
    assert set(r[0].context) == {"cwe", "autofix"} and r[1].context is None
    r = sc.remediation(frame({"queries": [{"query_name": "q", "platform": "p", "files": [{"expected_value": "", "actual_value": None}, {}]}]}), "kics").orderBy("ord").collect()
    assert [(x.ord, x.effort_mins, x.affected_symbol, x.context) for x in r] == [(0, 10, "q", {"expected_value": '""', "platform": '"p"'}), (1, 10, "q", {"platform": '"p"'})]
    match = lambda **fix: {"vulnerability": {"fix": fix}, "artifact": {"name": "n", "version": "1"}}
    r = sc.remediation(frame({"matches": [match(state="fixed", versions=["2"]), match(state="wont-fix", versions=["2"]), match(state="fixed", versions=[]), {}]}), "grype").orderBy("ord").collect()
    assert [(x.fix_type, x.fix_complexity, x.effort_mins, x.affected_symbol) for x in r] == [("upgrade", "trivial", 5, "n"), ("suppress", "moderate", 15, "n"), ("upgrade", "complex", 60, "n"), ("upgrade", "complex", 60, None)]
    assert r[0].context["fix_versions"] == '["2"]' and r[3].context is None
    got = sc.compliance_findings(frame({"issues": [{"title": "t", "type": "sast"}, {"category": "c", "type": "s"}]}, {"vulnerabilities": [{"name": "v", "severity": "HIGH", "location": {"file": "f"}}, {"title": "w"}]}, [{"severity": "Low", "type": "s"}], {"other": 1}))
    rows = [(r.path, r.title, r.severity, r.category, r.file) for r in got.orderBy("path", "ord").collect()]
    assert rows == [("0", "t", None, "sast", None), ("0", None, None, "c", None), ("1", "v", "high", "", "f"), ("1", "w", "medium", "", ""), ("2", None, "Low", None, None)]

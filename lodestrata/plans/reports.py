"""Registered queries over report bodies, texts and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import ids, vocab
from lodestrata.operators import reports as op
from lodestrata.operators.nested import latest_reports
from lodestrata.plans import findings as base
from lodestrata.sources import scanners
from lodestrata.storage import table
from lodestrata.streaming import tracking

# What is looked for in texts; patterns that RE2 and Java read alike.
TEXT_DETECTORS = [
    ("advisory", "HIGH", r"ADV-[0-9]{4}-[0-9]{5}"),
    ("licence", "LOW", r"(?i)\b(license|licence|copyright)\b"),
    ("suppression", "MEDIUM", r"(?i)ignore rule"),
    ("credential", "CRITICAL", r"(?i)(password|secret|token)"),
]


def _with_message(spark, d):
    return base._current(spark, d).withColumn("message", F.get_json_object("payload", "$.message"))


def sarif_rules_first_wins(spark, d):
    return op.sarif_rules(_with_message(spark, d), F.struct("ingested_at", "scan_id", "finding_id"))


def sarif_results(spark, d):
    return op.sarif_results(_with_message(spark, d)).select("scan_id", "finding_id", "result")


def vulnerability_report(spark, d):
    return op.vulnerability_rows(_with_message(spark, d))


def raw_sarif_findings(spark, d):
    """Results of the latest readable delivery of every report, wrapped ones included."""
    latest = latest_reports(table(spark, d, "raw_reports"))
    return scanners.sarif(latest.select(F.col("report_id").cast("string").alias("path"), F.to_json("report").alias("body")))


def upserted_records(spark, d):
    """Scan records after those delivered later are merged into those stored: by scan, the delivered one wins."""
    r = table(spark, d, "scan_records").select("scan_id", "scan_timestamp", "project", "finding_count").where("scan_id is not null")
    late = F.coalesce(F.col("scan_timestamp") >= F.lit("2031-07-01").cast("timestamp_ntz"), F.lit(False))
    return op.upserted(r.where(~late), r.where(late), "scan_id", "scan_timestamp")


def detect_texts(spark, d):
    """Which detectors a document's text sets off, and on which line first."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("content"))
    return scanners.detect(docs, TEXT_DETECTORS).select(F.col("file").alias("doc_id"), "type", "severity", "line")


def fixed_versions(spark, d):
    """The version that a range's text tells to move to."""
    ranges = table(spark, d, "occurrences").select("id", "declared_range").distinct()
    return ranges.select("id", "declared_range", scanners.fixed_version(F.col("declared_range")).alias("version")).where("version <> ''")


def redacted_matches(spark, d):
    """Every match in every text, redacted."""
    found = F.explode(F.regexp_extract_all("text", F.lit(r"[a-z]+-(?:utils|core|yaml)"), F.lit(0))).alias("m")
    return table(spark, d, "documents").select("doc_id", found).select("doc_id", ids.redacted(F.col("m")).alias("shown"))


def event_windows(spark, d):
    """Hourly counts by type from the stream of events."""
    stream = tracking.stream_of(spark, d, "events")
    out = tracking.drained(spark, tracking.windowed_counts(stream, "ts", "event_type", late="400 days"), ["start", "kind"], "n", "windows")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n")


def tracking_state(spark, d):
    """First and last event of every user, kept in streaming state."""
    stream = tracking.stream_of(spark, d, "events")
    out = tracking.drained(spark, tracking.sightings(stream, "user_id", "ts"), ["key"], "n", "sightings")
    stamp = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select("key", stamp("first_seen"), stamp("last_seen"), "n")


# The levels that the made reports give to our severities.
LEVELS = {"critical": "ERROR", "high": "WARNING"}


def _report(spark, d, *members):
    """(path, body): one scanner report of every finding of the last scans."""
    f = _with_message(spark, d).withColumn("level", vocab.lookup(F.col("severity"), LEVELS, "INFO"))
    return f.select(F.concat_ws("/", "scan_id", "finding_id").alias("path"), F.to_json(F.struct(*members)).alias("body"))


def _read(reader, reports, scanner):
    columns = ["path", "type", "rule_id", "cve_id", "title", "description", "file", "line", "severity", "category"]
    fixes = scanners.remediation(reports, scanner).select("path", "ord", "fix_type", "fix_complexity", "effort_mins", "affected_symbol")
    return reader(reports).join(fixes, ["path", "ord"], "left").select(*columns, "fix_type", "fix_complexity", "effort_mins", "affected_symbol")


def read_gitleaks(spark, d):
    one = F.struct(F.nullif("rule_id", F.lit("")).alias("RuleID"), F.col("file").alias("File"), F.col("line").alias("StartLine"))
    return _read(scanners.gitleaks, _report(spark, d, one.alias("x")).withColumn("body", F.regexp_replace("body", r'^\{"x":(.*)\}$', "[$1]")), "gitleaks")


def read_semgrep(spark, d):
    """Findings of high severity carry a weakness id; those of the category sast a fix."""
    cwe = F.when(F.col("severity").isin("critical", "high"), F.array(F.lit("CWE-1"))).alias("cwe")
    extra = F.struct(F.col("message"), F.col("level").alias("severity"), F.when(F.col("category") == "sast", F.lit("x")).alias("fix"), F.struct("category", cwe).alias("metadata"))
    one = F.struct(F.col("rule_id").alias("check_id"), F.col("file").alias("path"), F.struct("line").alias("start"), extra.alias("extra"))
    return _read(scanners.semgrep, _report(spark, d, F.array(one).alias("results")), "semgrep")


def read_kics(spark, d):
    one = F.struct(F.col("message").alias("query_name"), F.upper("severity").alias("severity"), F.col("category").alias("description"), F.array(F.struct(F.col("file").alias("file_name"), "line")).alias("files"))
    return _read(scanners.kics, _report(spark, d, F.array(one).alias("queries")), "kics")


def read_grype(spark, d):
    """Findings of an even line have a fix, those of a line that three divides never will."""
    state = F.when(F.col("line") % 2 == 0, "fixed").when(F.col("line") % 3 == 0, "wont-fix")
    fix = F.struct(state.alias("state"), F.when(F.col("line") % 2 == 0, F.array(F.lit("2.0"))).otherwise(F.array().cast("array<string>")).alias("versions"))
    vulnerability = F.struct(F.concat(F.lit("ADV-"), F.col("line")).alias("id"), "severity", F.col("message").alias("description"), fix.alias("fix"))
    artifact = F.struct(F.col("rule_id").alias("name"), F.lit("1.0").alias("version"), F.array(F.struct(F.nullif("file", F.lit("")).alias("path"))).alias("locations"))
    return _read(scanners.grype, _report(spark, d, F.array(F.struct(vulnerability.alias("vulnerability"), artifact.alias("artifact"))).alias("matches")), "grype")


def read_compliance(spark, d):
    """Stored findings as issues without a category."""
    one = F.struct(F.col("message").alias("title"), "severity", F.col("category").alias("type"), "file")
    return scanners.compliance_findings(_report(spark, d, F.array(one).alias("issues"))).select("path", "title", "severity", "category", "file")


QUERIES = {
    f.__name__: f
    for f in (sarif_rules_first_wins, sarif_results, vulnerability_report, raw_sarif_findings, upserted_records, detect_texts, fixed_versions, redacted_matches, event_windows, tracking_state, read_gitleaks, read_semgrep, read_kics, read_grype, read_compliance)
}
ORACLES = {
    "sarif_rules_first_wins": base.BASE + "SELECT rule_id, severity, payload->>'$.message' AS message FROM cur QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY ingested_at, scan_id, finding_id) = 1",
    "upserted_records": """SELECT scan_id, scan_timestamp, project, finding_count FROM scan_records WHERE scan_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY coalesce(scan_timestamp >= TIMESTAMP '2031-07-01', false) DESC, scan_timestamp DESC NULLS LAST, project DESC NULLS LAST, finding_count DESC NULLS LAST) = 1""",
    "sarif_results": base.BASE + f""", f AS (SELECT *, payload->>'$.message' AS message, {base._case("lower(severity)", vocab.SEVERITY_MAPS["sarif_level"], "'warning'")} AS level FROM cur)
SELECT scan_id, finding_id, '{{"ruleId":' || to_json(rule_id) || ',"level":' || to_json(level) || ',"message":' || coalesce('{{"text":' || to_json(message) || '}}', '{{}}') || ',"locations":' ||
  CASE WHEN regexp_matches(file, '^(dependency|image):') THEN '[{{"logicalLocations":[{{"fullyQualifiedName":' || to_json(file) || '}}]}}]'
  ELSE '[{{"physicalLocation":{{"artifactLocation":{{"uri":' || to_json(file) || '}},"region":{{"startLine":' || greatest(line, 1) || '}}}}}}]' END || '}}' AS result FROM f""",
    "vulnerability_report": base.BASE + f""", f AS (SELECT *, payload->>'$.message' AS message FROM cur)
SELECT finding_id, '{{"id":' || to_json(finding_id) || ',"category":' || to_json(CASE WHEN category IN ({", ".join(map(repr, vocab.STORED_CATEGORIES))}) THEN category ELSE {base._case("category", vocab.STORED_ALIASES, "'unknown'")} END)
  || ',"name":' || to_json(rule_id) || coalesce(',"message":' || to_json(message), '') || ',"severity":' || to_json(CASE WHEN severity IN ('critical','high','medium','low','info') THEN severity ELSE 'medium' END)
  || ',"location":{{"file":' || to_json(file) || ',"start_line":' || line || '}},"identifiers":[{{"type":"rule","name":' || to_json(rule_id) || ',"value":' || to_json(rule_id) || '}}]}}' AS vulnerability FROM f""",
    "detect_texts": "WITH p(type, severity, pattern) AS (VALUES " + ", ".join(f"('{t}', '{s}', '{p}')" for t, s, p in TEXT_DETECTORS) + r""") SELECT doc_id, type, severity, cast(coalesce(list_min(list_transform(list_filter(list_zip(string_split_regex(text, '\r\n|\n|\r'), range(1, 1 + len(string_split_regex(text, '\r\n|\n|\r')))), lambda x: regexp_matches(x[1], pattern)), lambda x: x[2])), 1) AS INT) AS line FROM documents, p WHERE regexp_matches(text, pattern)""",
    "fixed_versions": r"""WITH v AS (SELECT DISTINCT id, declared_range, coalesce(nullif(regexp_extract(declared_range, '(?i)(?:upgrade|update)\s+(?:to\s+)?(?:version\s+)?(\d+\.\d+[.\d]*)', 1), ''), nullif(regexp_extract(declared_range, '>=\s*(\d+\.\d+[.\d]*)', 1), '')) AS version FROM occurrences)
SELECT id, declared_range, version FROM v WHERE version IS NOT NULL""",
    "redacted_matches": "WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+-(?:utils|core|yaml)')) AS m FROM documents) SELECT doc_id, CASE WHEN length(m) <= 8 THEN '' ELSE left(m, 4) || '…' END || '***' || left(sha256(m), 8) AS shown FROM m",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type AS kind, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "tracking_state": "SELECT cast(user_id AS VARCHAR) AS key, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1",
}

_RAW = base.BASE + f""", f AS (SELECT scan_id || '/' || finding_id AS path, rule_id, file, line, severity, category, payload->>'$.message' AS message, {base._case("severity", LEVELS, "'INFO'")} AS level FROM cur)
"""
_SOME = lambda c, words: f"len(list_filter([{', '.join(repr(w) for w in words)}], lambda w: contains({c}, w))) > 0"
_FIX = lambda kind, level, effort, symbol: f"{kind} AS fix_type, {level} AS fix_complexity, {effort} AS effort_mins, {symbol} AS affected_symbol"
ORACLES |= {
    "read_gitleaks": _RAW + f"""SELECT path, 'Secrets' AS type, coalesce(nullif(rule_id, ''), 'exposed-secret') AS rule_id, NULL::VARCHAR AS cve_id, 'Exposed ' || coalesce(nullif(rule_id, ''), 'exposed-secret') AS title, 'Potential secret found; detected value redacted.' AS description,
file, line, 'critical' AS severity, 'hardcoded-secret' AS category, {_FIX("'code_change'", "'moderate'", 30, "coalesce(nullif(rule_id, ''), 'secret')")} FROM f""",
    "read_semgrep": _RAW + f""", g AS (SELECT *, severity IN ('critical', 'high') AS cwe, contains(category, 'owasp') OR contains(category, 'security') AS marked, {_SOME("lower(rule_id)", scanners.QUALITY_IDS)} OR {_SOME("category", scanners.QUALITY_CATEGORIES)} AS q, {_SOME("lower(coalesce(message, ''))", scanners.SECURITY_WORDS)} AS said FROM f)
SELECT path, 'SAST' AS type, rule_id, NULL::VARCHAR AS cve_id, rule_id AS title, coalesce(message, '') AS description, file, line, CASE WHEN level = 'ERROR' THEN 'high' ELSE 'medium' END AS severity, 'sast' AS category,
{_FIX("'code_change'", "CASE WHEN category = 'sast' THEN 'trivial' ELSE 'moderate' END", "CASE WHEN category = 'sast' THEN 5 ELSE 30 END", "nullif(regexp_extract(rule_id, '[^.]*$'), '')")} FROM g WHERE NOT q AND (cwe OR marked OR said) AND (level <> 'INFO' OR cwe OR marked)""",
    "read_kics": _RAW + f"""SELECT path, 'Infrastructure as Code' AS type, coalesce(message, '') AS rule_id, NULL::VARCHAR AS cve_id, coalesce(message, '') AS title, category AS description, coalesce(nullif(file, ''), 'unknown') AS file, line,
{base._case("upper(severity)", vocab.SEVERITY_MAPS["kics"], "'medium'")} AS severity, 'iac' AS category, {_FIX("'config'", "'trivial'", 10, "nullif(message, '')")} FROM f
WHERE NOT ({_SOME("lower(coalesce(message, ''))", scanners.QUALITY_MARKS)} OR {_SOME("lower(category)", scanners.QUALITY_MARKS)}) AND upper(severity) <> 'INFO'""",
    "read_grype": _RAW + f"""SELECT path, 'Dependency' AS type, 'ADV-' || line AS rule_id, 'ADV-' || line AS cve_id, rule_id || ' - ADV-' || line AS title, coalesce(message, 'Known vulnerability in dependency') AS description, coalesce(nullif(file, ''), 'dependency: ' || rule_id) AS file, 1 AS line, severity, 'dependency' AS category,
{_FIX("CASE WHEN line % 2 <> 0 AND line % 3 = 0 THEN 'suppress' ELSE 'upgrade' END", "CASE WHEN line % 2 = 0 THEN 'trivial' WHEN line % 3 = 0 THEN 'moderate' ELSE 'complex' END", "CASE WHEN line % 2 = 0 THEN 5 WHEN line % 3 = 0 THEN 15 ELSE 60 END", "nullif(rule_id, '')")} FROM f""",
    "read_compliance": _RAW + "SELECT path, message AS title, severity, category, file FROM f",
}

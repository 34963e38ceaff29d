"""Registered queries over findings, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import ids, paths, vocab
from lodestrata.functions.text import key
from lodestrata.operators import findings as op, stored
from lodestrata.operators.snapshots import scan_order
from lodestrata.storage import table

# Which categories each control of the three frameworks covers.
FRAMEWORKS = {
    "soc2": {
        "CC6.1": "secrets sast", "CC6.2": "secrets", "CC6.3": "sast", "CC6.6": "cve dependency_scanning", "CC6.7": "secrets iac",
        "CC6.8": "cve dependency_scanning sast", "CC7.1": "cve dependency_scanning sast iac", "CC7.2": "sast cve",
        "CC8.1": "sast iac dependency_scanning", "CC9.1": "cve dependency_scanning license_compliance",
    },
    "pci": {
        "2.2.1": "iac", "6.2.1": "sast", "6.2.2": "sast", "6.2.3": "sast secrets", "6.2.4": "sast", "6.3.1": "cve dependency_scanning",
        "6.3.2": "dependency_scanning license_compliance", "6.3.3": "cve dependency_scanning", "6.5.1": "iac sast", "6.5.2": "iac",
        "8.3.1": "secrets", "8.6.1": "secrets", "11.3.1": "cve dependency_scanning sast", "11.3.2": "cve dependency_scanning",
    },
    "hipaa": {
        "§164.312(a)(1)": "secrets sast", "§164.312(a)(2)(i)": "secrets", "§164.312(a)(2)(iv)": "secrets sast", "§164.312(b)": "sast iac",
        "§164.312(c)(1)": "sast iac", "§164.312(d)": "secrets", "§164.312(e)(1)": "secrets sast iac", "§164.312(e)(2)(ii)": "secrets sast",
        "§164.308(a)(1)(ii)(A)": "cve dependency_scanning sast", "§164.308(a)(5)(ii)(B)": "cve dependency_scanning",
        "§164.308(a)(8)": "cve dependency_scanning sast iac",
    },
}
RULES = [
    op.IgnoreRule(rule_id="custom.trudiplirr", permanent=True, reason="known"),
    op.IgnoreRule(file_path="vendor/*.js", permanent=True, reason="not ours"),
    op.IgnoreRule(file_path="*/test?/*", until="2031-06-01", reason="later"),
    op.IgnoreRule(message="Outdated Release", until="2032-01-01", reason="upgrade planned"),
    op.IgnoreRule(rule_id="never", reason="neither permanent nor dated"),
]

_T = r"E' \t\r\n\x0b\x0c'"
_PATH = r"regexp_replace(regexp_replace(replace(coalesce(file,''), '\', '/'), '^(\./)+', ''), '^/src/', '')"
BASE = rf"""
WITH cleaned AS (
  SELECT scan_id, coalesce(nullif(lower(trim(finding_id, {_T})), ''), sha256(coalesce(rule_id,'') || ':' || {_PATH} || ':' || coalesce(cast(line AS VARCHAR), '0'))) AS finding_id,
    ingested_at, coalesce(lower(trim(rule_id, {_T})), '') AS rule_id, {_PATH} AS file, coalesce(line, 0) AS line,
    coalesce(lower(trim(severity, {_T})), '') AS severity, coalesce(lower(trim(category, {_T})), '') AS category,
    coalesce(lower(trim(trend, {_T})), '') AS trend, scan_timestamp, payload
  FROM findings WHERE scan_id IS NOT NULL),
c AS (SELECT * FROM cleaned QUALIFY row_number() OVER (PARTITION BY scan_id, finding_id ORDER BY ingested_at DESC) = 1),
s AS (SELECT DISTINCT scan_id, lower(trim(project, {_T})) AS project, scan_timestamp AS taken FROM scan_records),
o AS (SELECT *, lead(scan_id) OVER w AS nxt, lag(scan_id) OVER w AS prv FROM s WINDOW w AS (PARTITION BY project ORDER BY taken, scan_id)),
cur AS (SELECT c.*, project FROM c JOIN o USING (scan_id) WHERE nxt IS NULL),
prev AS (SELECT c.*, l.project FROM c JOIN o l ON l.prv = c.scan_id WHERE l.nxt IS NULL)
"""


def _clean(spark, d):
    return op.cleaned(table(spark, d, "findings"))


def _scans(spark, d):
    return scan_order(table(spark, d, "scan_records"))


def _current(spark, d):
    """The last scan of every project."""
    last = _scans(spark, d).where("_next is null").select("scan_id", "project")
    return _clean(spark, d).join(last, "scan_id")


def _previous(spark, d):
    """The scan before the last of every project, under the project's name."""
    scans = _scans(spark, d)
    last = scans.where("_next is null").select(F.col("scan_id").alias("_last"), "project")
    before = scans.select("scan_id", F.col("_next").alias("_last")).join(last, "_last").drop("_last")
    return _clean(spark, d).join(before, "scan_id")


def _controls(spark, name):
    return spark.createDataFrame([(k, v.split()) for k, v in FRAMEWORKS[name].items()], "control_id string, categories array<string>")


def normalize_path_id(spark, d):
    f = table(spark, d, "findings")
    return f.select("rule_id", "file", "line", ids.normalize_path("file").alias("path"), ids.compute_finding_id(F.col("rule_id"), F.col("file"), F.col("line")).alias("id")).distinct()


def category_vocab(spark, d):
    c = F.col("category")
    f = table(spark, d, "findings").select("category").distinct()
    return f.select(
        "category", vocab.stored_category(F.coalesce(c, F.lit(""))).alias("stored"), vocab.compliance_category(c).alias("compliance"),
        vocab.policy_category(c).alias("policy"), vocab.gate_category(c).alias("gate"),
    )


def severity_vocab(spark, d):
    s = F.col("severity")
    f = table(spark, d, "findings").select("severity").distinct()
    return f.select(
        "severity", vocab.severity_rank(s).alias("rank"), vocab.report_rank(s).alias("report_rank"), vocab.display_order(s).alias("display"),
        vocab.gate_severity(s).alias("gate"), vocab.mapped_severity(s, "sarif_level").alias("sarif"), vocab.mapped_severity(s, "issue_priority").alias("priority"),
        vocab.mapped_severity(s, "grype").alias("grype"), vocab.mapped_severity(s, "php").alias("php"), vocab.mapped_severity(s, "kics").alias("kics"),
        vocab.sla_days(s).alias("sla"),
    )


def severity_rank_filter(spark, d):
    return op.by_severity(_current(spark, d), "high").select("scan_id", "finding_id", "severity")


def severity_sorted_top5(spark, d):
    return op.in_display_order(_current(spark, d), ["ingested_at", "scan_id", "finding_id"]).limit(5).select("finding_id", "severity", "file", "line")


def suppress_first_match(spark, d):
    f = _current(spark, d)
    columns = {"rule_id": F.col("rule_id"), "file": F.col("file"), "message": F.get_json_object("payload", "$.message")}
    hit = op.suppression(RULES, F.col("scan_timestamp"), columns)
    return f.select("scan_id", "finding_id", hit.alias("rule_no")).where("rule_no is not null")


def track_trend(spark, d):
    previous = _previous(spark, d).withColumn("first_seen", F.to_timestamp_ntz(F.substring(F.get_json_object("payload", "$.first_seen"), 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    return op.tracked(_current(spark, d), previous, ["project"]).select("project", "finding_id", "trend", "first_seen", "age_days")


def resolved_findings(spark, d):
    return op.resolved(_current(spark, d), _previous(spark, d), ["project"])


def scan_record_counts(spark, d):
    """finding_count, new_count (rows) and resolved_count (distinct ids) of every project's last scan."""
    cur, prev = _current(spark, d), _previous(spark, d)
    known = prev.select("project", "finding_id").distinct().withColumn("_old", F.lit(True))
    now = cur.join(known, ["project", "finding_id"], "left").groupBy("project").agg(F.count(F.lit(1)).alias("finding_count"), F.count_if(F.col("_old").isNull()).alias("new_count"))
    gone = op.resolved(cur, prev, ["project"]).groupBy("project").agg(F.count(F.lit(1)).alias("resolved_count"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return now.join(gone, "project", "full_outer").select("project", zero("finding_count"), zero("new_count"), zero("resolved_count"))


def baseline_new(spark, d):
    return op.not_in_baseline(_current(spark, d), _previous(spark, d), ["project"]).select("project", "finding_id", "rule_id", "file", "line")


def policy_violations(spark, d):
    r = table(spark, d, "policy_rules").dropDuplicates()
    rules = r.select("rule_no", key("action").alias("action"), "max_count", key("severity").alias("severity"), vocab.policy_category(key("category")).alias("category"))
    return op.violations(_current(spark, d), rules.distinct())


def gate_snapshot_dense(spark, d):
    return op.snapshot(_current(spark, d))


def gate_cohort_dense(spark, d):
    return op.cohorts(_current(spark, d), _previous(spark, d), ["project"])


def _coverage(name):
    return lambda spark, d: op.control_coverage(_current(spark, d), _controls(spark, name))


def compliance_unmapped(spark, d):
    return op.unmapped(_current(spark, d), _controls(spark, "soc2"))


def metrics_gauge(spark, d):
    return op.gauge(_current(spark, d))


def metrics_lines(spark, d):
    return op.exposition(op.gauge(_current(spark, d)))


def notify_payload(spark, d):
    """Counts of each project's last scan and whether anyone is to be told."""
    counts = op.severity_counts(_current(spark, d), ["project"])
    return counts.withColumn("notify", (F.col("critical") + F.col("high")) > 0)


def issue_sync_plan(spark, d):
    known = _previous(spark, d).where("severity in ('critical', 'high')").select("project", ids.issue_fingerprint(F.col("rule_id"), F.col("file")).alias("fingerprint"))
    return op.issue_plan(_current(spark, d), known, ["project"])


def pr_comments(spark, d):
    """Comments on findings of the last scans whose lines the scans before also touched."""
    changed = _previous(spark, d).select("project", "file", "line")
    return op.comments(op.on_changed_lines(_current(spark, d), changed, ["project"]), ["project"]).select("project", "file", "first_line", "n", "body")


def duplicate_findings(spark, d):
    f = table(spark, d, "findings").select("scan_id", key("rule_id").alias("rule_id"), ids.normalize_path("file").alias("file"), "line")
    return op.repeated(f)


def scope_prefix(spark, d):
    units = spark.createDataFrame([("vendor",), ("migrations",), ("web/lalweax",), ("lib/",)], "unit string")
    return op.in_scope(_current(spark, d), units).select("scan_id", "finding_id", "file")


def sla_overdue(spark, d):
    f = _current(spark, d).withColumns({"assigned_at": F.to_timestamp_ntz(F.substring(F.get_json_object("payload", "$.first_seen"), 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")), "sla_days": vocab.sla_days("severity")})
    now = F.to_timestamp(F.lit("2032-01-01 00:00:00"))
    return op.overdue(f, now).select("finding_id", "scan_id", "severity", "sla_days")


def source_profile(spark, d):
    """(facet, value, n) of the distinct paths: language, infrastructure, manifest and class."""
    p = table(spark, d, "findings").select(ids.normalize_path("file").alias("p")).distinct()
    facet = lambda name, c: F.struct(F.lit(name).alias("facet"), c.alias("value"))
    c = F.col("p")
    each = p.select(F.inline(F.array(facet("language", paths.language(c)), facet("infrastructure", paths.infrastructure(c)), facet("manifest", paths.manifest_type(c)), facet("class", paths.path_class(c)))))
    return each.where("value is not null").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def package_files(spark, d):
    """Format and ecosystem of the files that evidence was read from."""
    p = table(spark, d, "relationships").select(F.col("source.path").alias("path")).distinct()
    return p.select("path", paths.package_format(F.col("path")).alias("format"), paths.ecosystem_of(paths.package_format(F.col("path"))).alias("ecosystem"))


def budget_fold(spark, d):
    """Which rules of each project's last scan, in order, fit a budget of 25 findings."""
    per = _current(spark, d).groupBy("project", "rule_id").agg(F.count(F.lit(1)).alias("size"))
    from pyspark.sql import Window as W

    per = per.withColumn("ord", F.row_number().over(W.partitionBy("project").orderBy("rule_id")))
    return op.budget_fold(per.select("project", "ord", "size"), 25, "project")


def scan_trend(spark, d):
    counts = _clean(spark, d).groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))
    scans = table(spark, d, "scan_records").select("scan_id", key("project").alias("project"), F.col("scan_timestamp").alias("at")).distinct()
    return op.scan_to_scan(scans.join(counts, "scan_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))).select("project", "scan_id", "n", "change")


def stored_order(spark, d):
    return stored.stored_order(_clean(spark, d))


def newest_scans(spark, d):
    one = table(spark, d, "scan_records").select("scan_id", key("project").alias("project"), "scan_timestamp").where("scan_id is not null and project is not null").distinct()
    return stored.newest_first(one)


def otel_attributes(spark, d):
    return stored.otel_attributes(_current(spark, d)).select("finding_id", F.explode("attributes").alias("attribute", "value"))


def issue_summaries(spark, d):
    f = _current(spark, d).withColumn("message", F.get_json_object("payload", "$.message"))
    return f.select("scan_id", "finding_id", stored.issue_summary(F.col("severity"), F.col("message"), F.col("file")).alias("summary"))


def finding_sizes(spark, d):
    body = F.to_json(F.struct("rule_id", "file", "line", F.lit("stored").alias("scanner"), "severity"))
    return _current(spark, d).select("scan_id", "finding_id", stored.finding_size(body).alias("size"))


def aged_findings(spark, d):
    f = _current(spark, d).withColumn("age_days", F.get_json_object("payload", "$.age_days").cast("int"))
    return stored.aged(f).select("scan_id", "finding_id", "age_days")


def input_ordinals(spark, d):
    """Position of every evidence file in the order of paths."""
    p = table(spark, d, "relationships").select(F.col("source.path").alias("path")).where("path is not null").distinct()
    return stored.positions(p.withColumn("of", F.lit("inputs")), ["of"], [F.col("path")], ["path"], "ordinal").select("path", "ordinal")


QUERIES = {
    "stored_order": stored_order, "newest_scans": newest_scans, "otel_attributes": otel_attributes, "issue_summaries": issue_summaries, "finding_sizes": finding_sizes, "aged_findings": aged_findings, "input_ordinals": input_ordinals,
    "normalize_path_id": normalize_path_id, "category_vocab": category_vocab, "severity_vocab": severity_vocab, "severity_rank_filter": severity_rank_filter,
    "severity_sorted_top5": severity_sorted_top5, "suppress_first_match": suppress_first_match, "track_trend": track_trend, "resolved_findings": resolved_findings,
    "scan_record_counts": scan_record_counts, "baseline_new": baseline_new, "policy_violations": policy_violations, "gate_snapshot_dense": gate_snapshot_dense,
    "gate_cohort_dense": gate_cohort_dense, **{f"compliance_{n}": _coverage(n) for n in FRAMEWORKS}, "compliance_unmapped": compliance_unmapped,
    "metrics_gauge": metrics_gauge, "metrics_lines": metrics_lines, "notify_payload": notify_payload, "issue_sync_plan": issue_sync_plan, "pr_comments": pr_comments,
    "duplicate_findings": duplicate_findings, "scope_prefix": scope_prefix, "sla_overdue": sla_overdue, "source_profile": source_profile,
    "package_files": package_files, "budget_fold": budget_fold, "scan_trend": scan_trend,
}


def _case(c, table, default):
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v if isinstance(v, int) else repr(v)}" for k, v in table.items()) + f" ELSE {default} END"


def _gate(c):
    whens = " ".join(f"WHEN {c} IN ({', '.join(map(repr, v))}) THEN '{k}'" for k, v in vocab.GATE_FAMILIES.items())
    return f"CASE {whens} ELSE 'other' END"


_CONTAINER = ", ".join(map(repr, vocab.CONTAINER_SPELLINGS))
_LOOSE = "rule_id || '+' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(file, '\\', '/'), '/(\\./)+', '/', 'g'), '/{2,}', '/', 'g'), '^(\\./)+', ''), '(.)/\\.?$', '\\1')"
_LEVELS = "(VALUES ('critical'),('high'),('medium'),('low'),('unknown'))"
_KINDS = "(VALUES " + ",".join(f"('{c}')" for c in vocab.GATE_CATEGORIES) + ")"
_GS = "CASE WHEN severity IN ('critical','high','medium','low') THEN severity ELSE 'unknown' END"
_EXT = r"lower(regexp_extract(regexp_extract(p, '[^/]*$'), '[^.]\.*?(\.[^.]*)$', 1))"


def _values(table):
    return "(VALUES " + ",".join("(" + ",".join(f"'{x}'" for x in row) + ")" for row in table) + ")"


def _control_sql(name):
    rows = [(k, c) for k, v in FRAMEWORKS[name].items() for c in v.split()]
    return BASE + f""", ct AS (SELECT {_case("category", vocab.COMPLIANCE_ALIASES, "category")} AS category, count(*) AS n FROM cur GROUP BY 1)
SELECT k AS control_id, cast(coalesce(sum(n), 0) AS BIGINT) AS n FROM {_values(rows)} t(k, category) LEFT JOIN ct USING (category) GROUP BY 1"""


_lang = paths._inverted(paths.LANGUAGES)
_infra = paths._inverted(paths.INFRASTRUCTURE_EXTENSIONS)
_names = paths._inverted(paths.INFRASTRUCTURE_NAMES)
_formats = paths._inverted(paths.FORMAT_NAMES)
_dirs = {k: v.split() for k, v in paths.CLASS_DIRECTORIES.items()}


def _class_sql():
    out = []
    for c in paths.PATH_CLASSES:
        tests = [f"len(list_intersect(list_transform(string_split(p, '/')[:-2], lambda x: lower(x)), [{', '.join(map(repr, _dirs[c]))}])) > 0"]
        if c in paths.CLASS_NAMES:
            tests.append(f"regexp_matches(regexp_extract(p, '[^/]*$'), '{paths.CLASS_NAMES[c]}')")
        if c == "docs":
            tests.append(f"{_EXT} IN ({', '.join(map(repr, paths.DOC_EXTENSIONS))})")
        out.append(f"WHEN {' OR '.join(tests)} THEN '{c}'")
    return "CASE " + " ".join(out) + " ELSE 'production' END"


_ATTRIBUTES = {"finding.scan_id": "scan_id", "finding.finding_id": "finding_id", "finding.rule_id": "rule_id", "finding.severity": "severity", "finding.category": "category", "code.filepath": "file", "code.lineno": "line::VARCHAR"}
ORACLES = {
    "stored_order": BASE + "SELECT scan_id, finding_id, row_number() OVER (PARTITION BY scan_id ORDER BY file, line, finding_id) - 1 AS position FROM c",
    "newest_scans": BASE + "SELECT project, scan_id, row_number() OVER (PARTITION BY project ORDER BY taken DESC NULLS LAST, scan_id) - 1 AS position FROM s WHERE project <> '' AND scan_id IS NOT NULL",
    "otel_attributes": BASE + ", a AS (" + " UNION ALL ".join(f"SELECT finding_id, '{k}' AS attribute, {v} AS value FROM cur" for k, v in _ATTRIBUTES.items()) + ") SELECT * FROM a WHERE value <> ''",
    "issue_summaries": BASE + "SELECT scan_id, finding_id, '[' || upper(coalesce(nullif(severity, ''), 'unknown')) || '] ' || coalesce(payload->>'$.message', 'Security Finding') || CASE WHEN file <> '' THEN ' — ' || file ELSE '' END AS summary FROM cur",
    "finding_sizes": BASE + """SELECT scan_id, finding_id, CASE WHEN rule_id <> '' AND file <> '' AND line >= 1 THEN strlen('{"file":' || to_json(file) || ',"line":' || line || ',"rule_id":' || to_json(rule_id) || ',"scanner":"stored","severity":' || to_json(severity) || '}') END AS size FROM cur""",
    "aged_findings": BASE + "SELECT scan_id, finding_id, try_cast(payload->>'$.age_days' AS INT) AS age_days FROM cur WHERE try_cast(payload->>'$.age_days' AS INT) > 30",
    "input_ordinals": "SELECT path, row_number() OVER (ORDER BY path) - 1 AS ordinal FROM (SELECT DISTINCT source.path AS path FROM relationships) WHERE path IS NOT NULL",
    "normalize_path_id": f"""SELECT DISTINCT rule_id, file, line, {_PATH} AS path, sha256(coalesce(rule_id,'') || ':' || {_PATH} || ':' || coalesce(cast(line AS VARCHAR), '0')) AS id FROM findings""",
    "category_vocab": f"""WITH v AS (SELECT DISTINCT category, lower(trim(category, {_T})) AS k FROM findings)
SELECT category, CASE WHEN coalesce(k,'') IN ({", ".join(map(repr, vocab.STORED_CATEGORIES))}) THEN k ELSE {_case("coalesce(k,'')", vocab.STORED_ALIASES, "'unknown'")} END AS stored,
  {_case("coalesce(k,'')", vocab.COMPLIANCE_ALIASES, "coalesce(k,'')")} AS compliance, CASE WHEN k IN ({_CONTAINER}) THEN 'container_images' ELSE k END AS policy, {_gate("coalesce(k,'')")} AS gate FROM v""",
    "severity_vocab": f"""WITH v AS (SELECT DISTINCT severity, lower(trim(severity, {_T})) AS k FROM findings)
SELECT severity, {_case("coalesce(k,'low')", vocab.RANKS, 0)} AS rank, {_case("coalesce(k,'medium')", vocab.REPORT_RANKS, 1)} AS report_rank, {_case("coalesce(k,'low')", vocab.ORDER, 4)} AS display,
  CASE WHEN k IN ('critical','high','medium','low') THEN k ELSE 'unknown' END AS gate, {_case("lower(severity)", vocab.SEVERITY_MAPS["sarif_level"], "'warning'")} AS sarif,
  {_case("lower(severity)", vocab.SEVERITY_MAPS["issue_priority"], "'Medium'")} AS priority, {_case("severity", vocab.SEVERITY_MAPS["grype"], "'medium'")} AS grype,
  {_case("lower(severity)", vocab.SEVERITY_MAPS["php"], "'medium'")} AS php, {_case("severity", vocab.SEVERITY_MAPS["kics"], "'medium'")} AS kics,
  {_case("coalesce(nullif(k,''),'medium')", vocab.DEFAULT_SLA_DAYS, 90)} AS sla FROM v""",
    "severity_rank_filter": BASE + "SELECT scan_id, finding_id, severity FROM cur WHERE severity IN ('critical', 'high')",
    "severity_sorted_top5": BASE + f"SELECT finding_id, severity, file, line FROM cur ORDER BY {_case('severity', vocab.ORDER, 4)}, ingested_at, scan_id, finding_id LIMIT 5",
    "suppress_first_match": BASE + r""", m AS (SELECT *, CASE WHEN rule_id = 'custom.trudiplirr' THEN 0 WHEN file <> '' AND regexp_full_match(file, 'vendor/.*\.js', 's') THEN 1
  WHEN file <> '' AND regexp_full_match(file, '.*/test./.*', 's') AND scan_timestamp < TIMESTAMP '2031-06-01' THEN 2
  WHEN contains(lower(coalesce(payload->>'$.message', '')), 'outdated release') AND scan_timestamp < TIMESTAMP '2032-01-01' THEN 3 END AS rule_no FROM cur)
SELECT scan_id, finding_id, rule_no FROM m WHERE rule_no IS NOT NULL""",
    "track_trend": BASE + """, t AS (SELECT cur.*, p.finding_id IS NOT NULL AS known, coalesce(try_strptime(p.payload->>'$.first_seen', '%Y-%m-%dT%H:%M:%SZ'), cur.scan_timestamp) AS first_seen
  FROM cur LEFT JOIN prev p ON p.project = cur.project AND p.finding_id = cur.finding_id)
SELECT project, finding_id, CASE WHEN known THEN 'unchanged' ELSE 'new' END AS trend, first_seen, greatest(date_diff('day', cast(first_seen AS DATE), cast(scan_timestamp AS DATE)), 0) AS age_days FROM t""",
    "resolved_findings": BASE + "SELECT project, finding_id FROM prev EXCEPT SELECT project, finding_id FROM cur",
    "scan_record_counts": BASE + """, g AS (SELECT project, finding_id FROM prev EXCEPT SELECT project, finding_id FROM cur),
n AS (SELECT project, count(*) AS finding_count, count(*) FILTER ((project, finding_id) NOT IN (SELECT (project, finding_id) FROM prev)) AS new_count FROM cur GROUP BY 1),
r AS (SELECT project, count(*) AS resolved_count FROM g GROUP BY 1)
SELECT coalesce(n.project, r.project) AS project, coalesce(finding_count, 0) AS finding_count, coalesce(new_count, 0) AS new_count, coalesce(resolved_count, 0) AS resolved_count FROM n FULL JOIN r ON n.project = r.project""",
    "baseline_new": BASE + f""", pe AS (SELECT DISTINCT project AS pr, rule_id || ':' || {_PATH} || ':' || line AS k FROM prev), pl AS (SELECT DISTINCT project AS pr, {_LOOSE} AS k FROM prev)
SELECT project, finding_id, rule_id, file, line FROM cur WHERE NOT EXISTS (FROM pe WHERE pr = project AND k = rule_id || ':' || {_PATH} || ':' || line) AND NOT EXISTS (FROM pl WHERE pr = project AND k = {_LOOSE})""",
    "policy_violations": BASE + f""", r AS (SELECT DISTINCT rule_no, nullif(lower(trim(action, {_T})), '') AS action, coalesce(max_count, 0) AS max_count,
  nullif(lower(trim(severity, {_T})), '') AS s, CASE WHEN lower(trim(category, {_T})) IN ({_CONTAINER}) THEN 'container_images' ELSE nullif(lower(trim(category, {_T})), '') END AS k FROM policy_rules),
f AS (SELECT severity, CASE WHEN category IN ({_CONTAINER}) THEN 'container_images' ELSE category END AS category FROM cur)
SELECT rule_no, action, count(*) AS n, max_count FROM r JOIN f ON (s IS NULL OR s = severity) AND (k IS NULL OR k = category) WHERE action <> 'ignore' GROUP BY rule_no, action, max_count, s, k HAVING count(*) > max_count""",
    "gate_snapshot_dense": BASE + f""", f AS (SELECT {_gate("category")} AS category, {_GS} AS severity FROM cur), k AS (SELECT * FROM {_KINDS} t(category) UNION ALL SELECT NULL), l AS (SELECT * FROM {_LEVELS} t(severity) UNION ALL SELECT NULL)
SELECT k.category, l.severity, (SELECT count(*) FROM f WHERE (k.category IS NULL OR f.category = k.category) AND (l.severity IS NULL OR f.severity = l.severity)) AS n FROM k, l""",
    "gate_cohort_dense": BASE + f""", f AS (SELECT {_gate("category")} AS category, CASE WHEN (project, finding_id) IN (SELECT (project, finding_id) FROM prev) THEN 'existing' ELSE 'new' END AS cohort, {_GS} AS severity FROM cur)
SELECT k.category, h.cohort, l.severity, count(f.category) AS n FROM {_KINDS} k(category) CROSS JOIN (VALUES ('new'),('existing')) h(cohort) CROSS JOIN {_LEVELS} l(severity)
LEFT JOIN f ON f.category = k.category AND f.cohort = h.cohort AND f.severity = l.severity GROUP BY ALL""",
    **{f"compliance_{n}": _control_sql(n) for n in FRAMEWORKS},
    "compliance_unmapped": BASE + f"SELECT {_case('category', vocab.COMPLIANCE_ALIASES, 'category')} AS category, count(*) AS n FROM cur GROUP BY 1 HAVING category NOT IN ({', '.join(sorted({repr(c) for v in FRAMEWORKS['soc2'].values() for c in v.split()}))})",
    "metrics_gauge": BASE + "SELECT coalesce(nullif(severity,''),'unknown') AS severity, coalesce(nullif(category,''),'unknown') AS category, project, count(*) AS n FROM cur GROUP BY ALL",
    "metrics_lines": BASE + r"""SELECT 'findings_total{severity="' || coalesce(nullif(severity,''),'unknown') || '",category="' || coalesce(nullif(category,''),'unknown') || '",project="' || project || '"} ' || count(*) AS line FROM cur GROUP BY coalesce(nullif(severity,''),'unknown'), coalesce(nullif(category,''),'unknown'), project""",
    "notify_payload": BASE + "SELECT project, count(*) FILTER (severity='critical') AS critical, count(*) FILTER (severity='high') AS high, count(*) FILTER (severity='medium') AS medium, count(*) FILTER (severity='low') AS low, count(*) FILTER (severity IN ('critical','high')) > 0 AS notify FROM cur GROUP BY 1",
    "issue_sync_plan": BASE + """, a AS (SELECT project, sha256(rule_id || ':' || file) AS fingerprint, min(CASE severity WHEN 'critical' THEN 0 ELSE 1 END) AS r FROM cur WHERE severity IN ('critical','high') GROUP BY ALL),
b AS (SELECT DISTINCT project, sha256(rule_id || ':' || file) AS fingerprint FROM prev WHERE severity IN ('critical','high'))
SELECT coalesce(a.project, b.project) AS project, coalesce(a.fingerprint, b.fingerprint) AS fingerprint, CASE WHEN a.fingerprint IS NULL THEN 'close' WHEN b.fingerprint IS NOT NULL THEN 'skip' ELSE 'create' END AS action, CASE r WHEN 0 THEN 'Highest' WHEN 1 THEN 'High' END AS priority FROM a FULL JOIN b ON a.project = b.project AND a.fingerprint = b.fingerprint""",
    "pr_comments": BASE + f"SELECT project, file, min(line) AS first_line, count(*) AS n, string_agg('- ' || rule_id || ' (line ' || line || ')', chr(10) ORDER BY {_case('severity', vocab.ORDER, 4)}, line, rule_id) AS body FROM cur WHERE file <> '' AND (project, file, line) IN (SELECT (project, file, line) FROM prev) GROUP BY ALL",
    "duplicate_findings": f"SELECT scan_id, nullif(lower(trim(rule_id, {_T})), '') AS rule_id, {_PATH} AS file, line, count(*) AS n FROM findings GROUP BY ALL HAVING count(*) > 1",
    "scope_prefix": BASE + "SELECT scan_id, finding_id, file FROM cur WHERE file = 'vendor' OR starts_with(file, 'vendor/') OR file = 'migrations' OR starts_with(file, 'migrations/') OR file = 'web/lalweax' OR starts_with(file, 'web/lalweax/')",
    "sla_overdue": BASE + f", a AS (SELECT *, try_strptime(payload->>'$.first_seen', '%Y-%m-%dT%H:%M:%SZ') AS since, {_case(chr(99)+'oalesce(nullif(severity,' + chr(39)*2 + '),' + repr('medium') + ')', vocab.DEFAULT_SLA_DAYS, 90)} AS sla_days FROM cur) SELECT finding_id, scan_id, severity, sla_days FROM a WHERE epoch(TIMESTAMP '2032-01-01' - since) / 86400 > sla_days",
    "source_profile": f"""WITH f AS (SELECT DISTINCT {_PATH} AS p FROM findings), x AS (
SELECT 'language' AS facet, {_case(_EXT, _lang, "NULL")} AS value FROM f
UNION ALL SELECT 'infrastructure', CASE WHEN regexp_extract(p, '[^/]*$') IN ({", ".join(map(repr, _names))}) THEN {_case("regexp_extract(p, '[^/]*$')", _names, "NULL")} WHEN starts_with(regexp_extract(p, '[^/]*$'), 'Dockerfile.') THEN 'dockerfile' ELSE {_case(_EXT, _infra, "NULL")} END FROM f
UNION ALL SELECT 'manifest', CASE WHEN regexp_matches(regexp_extract(p, '[^/]*$'), '^requirements.*\\.txt$') THEN 'pip-requirements' ELSE {_case("regexp_extract(p, '[^/]*$')", _formats, "NULL")} END FROM f
UNION ALL SELECT 'class', {_class_sql()} FROM f) SELECT facet, value, count(*) AS n FROM x WHERE value IS NOT NULL GROUP BY ALL""",
    "package_files": f"""WITH f AS (SELECT DISTINCT source.path AS path, regexp_extract(source.path, '[^/]*$') AS b FROM relationships), g AS (SELECT path, CASE WHEN b IN ({", ".join(map(repr, _formats))}) THEN {_case("b", _formats, "NULL")}
 WHEN regexp_matches(b, '^pylock(\\.[^.]+)?\\.toml$') THEN 'python-pylock' WHEN b LIKE '%.py.lock' THEN 'python-uv-script-lock' WHEN b LIKE '%.in' OR b LIKE '%.txt' OR b LIKE '%.pip' THEN 'pip-requirements' END AS format FROM f)
SELECT path, format, {_case("string_split(format, '-')[1]", paths.ECOSYSTEMS, "NULL")} AS ecosystem FROM g""",
    "budget_fold": BASE + """, per AS (SELECT project, rule_id, count(*) AS size FROM cur GROUP BY ALL), o2 AS (SELECT project, cast(row_number() OVER (PARTITION BY project ORDER BY rule_id) AS INT) AS ord, size FROM per)
, w AS (WITH RECURSIVE w AS (
  SELECT project, ord, CASE WHEN size <= 25 THEN size ELSE 0 END AS used, size <= 25 AS kept FROM o2 WHERE ord = 1
  UNION ALL SELECT r.project, r.ord, w.used + CASE WHEN w.used + size <= 25 THEN size ELSE 0 END, w.used + size <= 25 FROM w JOIN o2 r ON r.project = w.project AND r.ord = w.ord + 1) SELECT * FROM w)
SELECT project, ord, kept FROM w""",
    "scan_trend": BASE + """, n AS (SELECT scan_id, count(*) AS n FROM c GROUP BY 1), j AS (SELECT s.*, coalesce(n, 0) AS n FROM s LEFT JOIN n USING (scan_id))
SELECT project, scan_id, n, n - lag(n) OVER (PARTITION BY project ORDER BY taken, scan_id) AS change FROM j""",
}

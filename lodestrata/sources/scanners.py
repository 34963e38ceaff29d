"""Scanner output and stored reports as finding rows.

Every reader takes (path, body) rows of JSON text, as `spark.read.text(wholetext=True)` gives them,
parses the body once into a VARIANT and stays in the JVM. A body that can't be parsed or lacks the
container is one row of `refused` with its reason; it never passes for an empty report.

Finding columns: path (of the report), ord (position in it), scanner, type, rule_id, cve_id, title,
description, file, line, severity, category.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from lodestrata.functions import vocab
from lodestrata.functions.ids import normalize_path
from lodestrata.operators.nested import as_list_of, as_map_of, listed, member, text

# What marks a rule's result as code quality instead of security.
QUALITY_CATEGORIES = ["best practice", "performance", "correctness", "maintainability", "readability", "code style", "style", "complexity", "testing", "quality", "error-handling"]
SECURITY_WORDS = ["vulnerability", "injection", "xss", "csrf", "sql", "secret", "credential", "auth"]
QUALITY_IDS = """python.use-none-param python.bad-open-file-mode python.bad-exception-caught python.bad-open-mode python.duplicate-function-def python.useless-return
python.useless-else python.redundant-unless python.unreachable-code python.use-setliteral python.use-dict-literal python.use-list-literal javascript.comparison-with-nan
javascript.useless-assignment javascript.no-delete-var javascript.no-empty-block javascript.no-template-curly-in-string javascript.no-const-assign javascript.no-throw-literal
javascript.catch-error-name javascript.no-console-spam javascript.performance javascript.performance.* python.performance.* pytest.* unittest.* mocha.* jest.* complexity
cyclomatic-complexity cognitive-complexity max-params max-lines max-len""".split()
# Names of queries that are about code quality.
QUALITY_QUERIES = """Unused container instruction; Container image tag; Container image digest is missing; Container image uses latest tag; Dockerfile command not latest;
Dockerfile instruction should not be used multiple times; Dockerfile line length should be less than 200 characters; Dockerfile use JSON array for RUN instructions;
File permissions; Inappropriate file permissions; Root user in container; User in Dockerfile; Missing health check; Health check not enabled;
Kubernetes labels not present; Kubernetes annotations not present; Metadata labels not set; Missing Kubernetes labels; Missing Kubernetes annotations;
Terraform output not defined; Terraform module has no source; Terraform module source is missing; Terraform variable not defined; Terraform variable is not used;
Terraform output description; Terraform variable description; Terraform resource description; Terraform module description; Terraform provider description;
Terraform resource tag; Terraform module tag; Terraform provider tag; Terraform variable tag; Terraform output tag; AWS resource missing tags; Missing tags;
Resource tagging; Description missing; Description is missing; Comment missing; Best practices; Optimization; Performance; Cost optimization; Cost; Resource naming;
Naming convention; Naming; Consistency; Maintainability; Readability; Code style; Style; Format; Formatting; Lint; Linter; Best Practice; Code organization;
Code structure; Code layout; Code pattern; Pattern"""
# Further texts that mark a query's name or description as code quality.
QUALITY_TEXTS = """best practice; optimization; performance; cost optimization; resource naming; naming convention; maintainability; readability; code style;
code organization; code structure; code layout; code pattern; line length; formatting; format; indentation; description missing; comment missing; documentation;
missing tags; resource tagging; metadata labels; metadata annotations; health check; liveness probe; readiness probe; root user; runs as root; user in dockerfile"""
QUALITY_MARKS = sorted({re.sub(r"\s+", " ", x).strip().lower() for x in f"{QUALITY_QUERIES}; {QUALITY_TEXTS}".split(";")})
COLUMNS = ["path", "ord", "scanner", "type", "rule_id", "cve_id", "title", "description", "file", "line", "severity", "category"]


def bodies(spark, location: str) -> DataFrame:
    """(path, body) of whole files."""
    return spark.read.text(location, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))


def _parsed(reports: DataFrame) -> DataFrame:
    return reports.select("path", F.try_parse_json(F.regexp_replace("body", "^﻿", "")).alias("v"))


def refused(reports: DataFrame, container: str | None) -> DataFrame:
    """(path, reason) of bodies that are no JSON or lack the list under `container` (None: the body itself)."""
    v = F.col("v")
    inside = as_list_of(v) if container is None else as_list_of(member(v, container))
    reason = F.when(v.isNull(), "invalid-json").when(inside.isNull(), "missing-list")
    return _parsed(reports).select("path", reason.alias("reason")).where("reason is not null")


def _each(reports: DataFrame, entries: Column) -> DataFrame:
    return _parsed(reports).select("path", F.posexplode(entries).alias("ord", "e"))


def _line(v: Column, default: int = 1) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "int"), F.lit(default))


def _of(df: DataFrame, name: str, /, **columns: Column) -> DataFrame:
    values = {c: F.lit(None).cast("string") for c in COLUMNS} | {"scanner": F.lit(name)} | columns
    return df.select("path", "ord", *[values[c].alias(c) for c in COLUMNS[2:]])


def gitleaks(reports: DataFrame) -> DataFrame:
    """Secrets: always critical; the matched text is left behind."""
    df, e = _each(reports, listed(F.col("v"))), F.col("e")
    rule = F.coalesce(text(member(e, "RuleID")), F.lit("exposed-secret"))
    return _of(df, "gitleaks", type=F.lit("Secrets"), rule_id=rule, title=F.concat(F.lit("Exposed "), rule), description=F.lit("Potential secret found; detected value redacted."),
               file=F.coalesce(text(member(e, "File")), F.lit("unknown")), line=_line(member(e, "StartLine")), severity=F.lit("critical"), category=F.lit("hardcoded-secret"))


def semgrep(reports: DataFrame, keep_quality: bool = False) -> DataFrame:
    """Rule results: code quality and informational results without security metadata are left out."""
    df, e = _each(reports, listed(member(F.col("v"), "results"))), F.col("e")
    extra = member(e, "extra")
    meta, message = member(extra, "metadata"), F.coalesce(text(member(extra, "message")), F.lit(""))
    rule, category = F.coalesce(text(member(e, "check_id")), F.lit("unknown")), F.lower(F.coalesce(text(member(meta, "category")), F.lit("")))
    present = lambda c: F.coalesce(F.to_json(member(meta, c)), F.lit("null")).isin('""', "null", "[]", "false") == F.lit(False)
    has_any = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: c.contains(w))
    marked = category.contains("owasp") | category.contains("security")
    quality = has_any(F.lower(rule), QUALITY_IDS) | has_any(category, QUALITY_CATEGORIES) | (~present("cwe") & ~marked & ~has_any(F.lower(message), SECURITY_WORDS))
    secure = present("cwe") | marked | present("owasp") | present("security-severity") | present("impact")
    level = F.upper(F.coalesce(text(member(extra, "severity")), F.lit("")))
    if not keep_quality:
        df = df.where(~quality & ((level != "INFO") | secure))
    return _of(df, "semgrep", type=F.lit("SAST"), rule_id=rule, title=rule, description=message, file=F.coalesce(text(member(e, "path")), F.lit("unknown")),
               line=_line(member(member(e, "start"), "line")), severity=vocab.semgrep_severity(level, text(member(meta, "security-severity"))), category=F.lit("sast"))


def semgrep_errors(reports: DataFrame) -> DataFrame:
    """(path, type, fatal, n) of reported errors: any level but warn or info makes the report unusable."""
    df, e = _each(reports, listed(member(F.col("v"), "errors"))), F.col("e")
    fatal = ~F.lower(F.coalesce(text(member(e, "level")), F.lit(""))).isin("warn", "info")
    return df.groupBy("path", F.coalesce(text(member(e, "type")), F.lit("unknown")).alias("type"), fatal.alias("fatal")).agg(F.count(F.lit(1)).alias("n"))


def kics(reports: DataFrame) -> DataFrame:
    """Queries by file: quality queries and those of level INFO, in just this spelling, are left out."""
    df, q = _each(reports, listed(member(F.col("v"), "queries"))), F.col("e")
    files, results = as_list_of(member(q, "files")), as_list_of(member(q, "results"))
    name, description = F.coalesce(text(member(q, "query_name")), F.lit("")), F.coalesce(text(member(q, "description")), F.lit(""))
    level = F.coalesce(text(member(q, "severity")), F.lit("MEDIUM"))
    quality = F.exists(F.array(*map(F.lit, QUALITY_MARKS)), lambda w: F.lower(name).contains(w) | F.lower(description).contains(w))
    entries = F.when(F.size(files) > 0, files).otherwise(F.coalesce(results, F.array().cast("array<variant>")))
    df = df.where(~quality & (level != "INFO")).select("path", (F.col("ord") * F.lit(1_000_000)).alias("_q"), "e", F.posexplode(entries).alias("_i", "r"))
    df, r = df.withColumn("ord", F.col("_q") + F.col("_i")), F.col("r")
    file = F.coalesce(F.nullif(text(member(r, "file_name")), F.lit("")), F.nullif(text(member(r, "file")), F.lit("")), F.lit("unknown"))
    return _of(df, "kics", type=F.lit("Infrastructure as Code"), rule_id=name, title=name, description=description, file=file, line=_line(member(r, "line")),
               severity=vocab.mapped_severity(level, "kics"), category=F.lit("iac"))


def grype(reports: DataFrame, image: bool = False) -> DataFrame:
    """Matches of known vulnerabilities; of an image, the rule names the package and version too."""
    df, m = _each(reports, listed(member(F.col("v"), "matches"))), F.col("e")
    vulnerability, artifact = member(m, "vulnerability"), member(m, "artifact")
    cve, name = F.nullif(text(member(vulnerability, "id")), F.lit("")), F.coalesce(text(member(artifact, "name")), F.lit("unknown"))
    first = F.get(F.filter(F.transform(listed(member(artifact, "locations")), lambda x: F.coalesce(F.nullif(text(member(x, "path")), F.lit("")), text(member(x, "accessPath")))), lambda x: x.isNotNull()), F.lit(0))
    level = F.lower(F.coalesce(text(member(vulnerability, "severity")), F.lit("medium")))
    if image:
        rule = F.concat(F.coalesce(cve, F.lit("unknown")), F.lit(":"), name, F.lit("@"), F.coalesce(text(member(artifact, "version")), F.lit("unknown")))
        level = F.when(level.isin(*vocab.SEVERITIES), level).otherwise("medium")
    else:
        rule = F.coalesce(cve, name)
    return _of(df, "grype", type=F.lit("Container" if image else "Dependency"), rule_id=rule, cve_id=cve, title=F.concat_ws(" - ", name, cve),
               description=F.coalesce(text(member(vulnerability, "description")), F.lit("Known vulnerability in dependency")), line=F.lit(1), severity=level,
               file=F.concat(F.lit("image: "), name) if image else F.coalesce(first, F.concat(F.lit("dependency: "), name)), category=F.lit("container_scanning" if image else "dependency"))


# What is to be done about an exposed secret.
SECRET_STEPS = ["rotate the exposed secret immediately", "remove the secret from the working tree and rewrite history", "store the new secret in a secrets manager"]


def remediation(reports: DataFrame, scanner: str) -> DataFrame:
    """(path, ord, fix_type, fix_complexity, effort_mins, affected_symbol, context) of the entries of a scanner's reports.

    `ord` is that of the scanner's reader; entries that the reader leaves out are here too. `context` is a map of JSON
    texts without null and empty members, null if none is left.
    """
    v, e, lit = F.col("v"), F.col("e"), F.lit
    given = lambda x: F.nullif(text(x), lit(""))
    js = lambda x: F.to_json(x)
    filled = lambda x: F.when(~F.coalesce(js(x), lit("null")).isin("null", '""', "[]", "{}", "false", "0"), js(x))
    if scanner == "gitleaks":
        df = _each(reports, listed(v))
        symbol = F.coalesce(given(member(e, "RuleID")), lit("secret"))
        kind, level, effort = lit("code_change"), lit("moderate"), lit(30)
        context = {"secret_kind": F.to_json(F.array(symbol)).substr(lit(2), F.length(F.to_json(F.array(symbol))) - 2), "remediation_steps": F.to_json(F.array(*map(lit, SECRET_STEPS)))}
    elif scanner == "semgrep":
        df = _each(reports, listed(member(v, "results")))
        extra = member(e, "extra")
        meta, fix = member(extra, "metadata"), filled(member(extra, "fix"))
        symbol = F.nullif(F.substring_index(text(member(e, "check_id")), ".", -1), lit(""))
        kind, level, effort = lit("code_change"), F.when(fix.isNotNull(), "trivial").otherwise("moderate"), F.when(fix.isNotNull(), 5).otherwise(30)
        context = {c: filled(member(meta, c)) for c in ("cwe", "owasp", "references")} | {"autofix": fix}
    elif scanner == "kics":
        df = _each(reports, listed(member(v, "queries")))
        files = as_list_of(member(e, "files"))
        entries = F.when(F.size(files) > 0, files).otherwise(F.coalesce(as_list_of(member(e, "results")), F.array().cast("array<variant>")))
        df = df.select("path", (F.col("ord") * lit(1_000_000)).alias("_q"), "e", F.posexplode(entries).alias("_i", "r")).withColumn("ord", F.col("_q") + F.col("_i"))
        symbol = F.coalesce(given(member(e, "query_name")), given(member(e, "queryName")))
        kind, level, effort = lit("config"), lit("trivial"), lit(10)
        said = lambda x: F.when(~F.coalesce(F.is_variant_null(x), lit(True)), js(x))
        context = {c: said(member(F.col("r"), c)) for c in ("expected_value", "actual_value")} | {c: filled(member(e, c)) for c in ("category", "platform")}
    else:
        df = _each(reports, listed(member(v, "matches")))
        artifact, fix = member(e, "artifact"), member(member(e, "vulnerability"), "fix")
        state, fixes = text(member(fix, "state")), filled(member(fix, "versions"))
        symbol = given(member(artifact, "name"))
        mended, left = F.coalesce((state == "fixed") & fixes.isNotNull(), lit(False)), F.coalesce(state == "wont-fix", lit(False))
        kind = F.when(~mended & left, "suppress").otherwise("upgrade")
        level = F.when(mended, "trivial").when(left, "moderate").otherwise("complex")
        effort = F.when(mended, 5).when(left, 15).otherwise(60)
        context = {"package": filled(member(artifact, "name")), "current_version": filled(member(artifact, "version")), "fix_versions": fixes, "fix_state": filled(member(fix, "state")), "cvss": filled(member(member(e, "vulnerability"), "cvss"))}
    pairs = F.map_filter(F.create_map(*[x for k, c in context.items() for x in (lit(k), c)]), lambda _, x: x.isNotNull())
    return df.select("path", "ord", kind.alias("fix_type"), level.alias("fix_complexity"), effort.alias("effort_mins"), symbol.alias("affected_symbol"), F.when(F.size(pairs) > 0, pairs).alias("context"))


def compliance_findings(reports: DataFrame) -> DataFrame:
    """(path, ord, title, description, severity, category, file) as a compliance report reads stored findings.

    `issues` as they stand, a missing category taken from the type; else `vulnerabilities` by their names, severity in lower
    case and medium if missing, other texts empty; else a list as it stands.
    """
    v, e = F.col("v"), F.col("e")
    issues, found = member(v, "issues"), member(v, "vulnerabilities")
    none = F.array().cast("array<variant>")
    shape = F.when(issues.isNotNull(), "issues").when(found.isNotNull(), "vulnerabilities").otherwise("list")
    entries = F.when(shape == "issues", listed(issues)).when(shape == "vulnerabilities", listed(found)).otherwise(F.coalesce(as_list_of(v), none))
    df = _parsed(reports).select("path", shape.alias("_shape"), F.posexplode(entries).alias("ord", "e"))
    get, flat = lambda c: text(member(e, c)), F.col("_shape") != "vulnerabilities"
    empty = lambda c: F.coalesce(c, F.lit(""))
    kind = F.when((F.col("_shape") == "issues") & member(e, "category").isNull(), get("type")).otherwise(get("category"))
    return df.select(
        "path", "ord", F.when(flat, get("title")).otherwise(F.coalesce(get("name"), get("title"), F.lit(""))).alias("title"),
        F.when(flat, get("description")).otherwise(empty(get("description"))).alias("description"),
        F.when(flat, get("severity")).otherwise(F.lower(F.coalesce(get("severity"), F.lit("medium")))).alias("severity"),
        F.when(flat, kind).otherwise(empty(get("category"))).alias("category"),
        F.when(flat, get("file")).otherwise(empty(text(member(member(e, "location"), "file")))).alias("file"),
    )


def fixable(reports: DataFrame) -> DataFrame:
    """(path, package, current_version, fixed_version, cve_id, severity, cvss_score, data_source) of matches that have a fix."""
    df, m = _each(reports, listed(member(F.col("v"), "matches"))), F.col("e")
    vulnerability, artifact = member(m, "vulnerability"), member(m, "artifact")
    fixes = listed(member(member(vulnerability, "fix"), "versions"))
    score = F.try_variant_get(vulnerability, "$.cvss[0].metrics.baseScore", "double")
    return df.where(F.size(fixes) > 0).select(
        "path", text(member(artifact, "name")).alias("package"), text(member(artifact, "version")).alias("current_version"), text(F.get(fixes, F.lit(0))).alias("fixed_version"),
        text(member(vulnerability, "id")).alias("cve_id"), text(member(vulnerability, "severity")).alias("severity"), score.alias("cvss_score"), text(member(vulnerability, "dataSource")).alias("data_source"),
    )


def fixed_version(solution: Column) -> Column:
    """The version that a solution text tells to move to; empty if it names none."""
    patterns = [
        r"(?i)(?:upgrade|update)\s+(?:to\s+)?(?:version\s+)?(\d+\.\d+[.\d]*)",
        r">=\s*(\d+\.\d+[.\d]*)",
        r"(?i)version\s+(\d+\.\d+[.\d]*)\s+(?:or|and)\s+(?:later|above|higher)",
    ]
    found = [F.nullif(F.regexp_extract(solution, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*found, F.lit(""))


def _shapes(e: Column) -> dict[str, Column]:
    """The spellings under which a finding may name its rule, file and line."""
    location = member(e, "location")
    inner = member(location, "file")
    some = lambda *paths: F.coalesce(*[F.nullif(text(p), F.lit("")) for p in paths])
    named = F.when(as_map_of(inner).isNotNull(), some(member(inner, "file_name"), member(inner, "path"), member(inner, "name"))).otherwise(some(inner))
    line = [F.try_variant_get(x, "$", "int") for x in (member(e, "line"), member(location, "start_line"), member(e, "start_line"))]
    scanner = member(e, "scanner")
    return {
        "rule": some(member(e, "rule_id"), member(e, "ruleId"), member(e, "check_id"), member(e, "id")),
        "file": normalize_path(F.coalesce(some(member(e, "file"), member(e, "file_name")), named, some(member(location, "path"), member(e, "path"), member(e, "filename")))),
        "line": F.coalesce(*line, F.lit(0)),
        "scanner": F.when(as_map_of(scanner).isNotNull(), some(member(scanner, "name"), member(scanner, "id"))).otherwise(some(scanner)),
    }


def stored(reports: DataFrame) -> DataFrame:
    """Findings of a report in any stored shape: a list, `vulnerabilities` or `issues`; fields under their aliases."""
    v = F.col("v")
    entries = F.coalesce(as_list_of(member(v, "vulnerabilities")), as_list_of(member(v, "issues")), as_list_of(v), F.array().cast("array<variant>"))
    df, e = _each(reports, entries), F.col("e")
    df = df.where(as_map_of(e).isNotNull())
    s = _shapes(e)
    get = lambda c: text(member(e, c))
    out = _of(df, "unknown", scanner=s["scanner"], type=get("type"), rule_id=s["rule"], cve_id=get("cve_id"), title=F.coalesce(get("title"), get("name")), description=F.coalesce(get("message"), get("description")),
              file=s["file"], line=s["line"], severity=get("severity"), category=F.coalesce(get("category"), get("type")))
    return out


def scan_records(reports: DataFrame) -> DataFrame:
    """Scan records of stored reports: the embedded one first, then the list."""
    v = F.col("v")
    entries = F.concat(listed(member(v, "scan_record")), listed(member(v, "scan_records")))
    df, e = _each(reports, entries), F.col("e")
    texts = ["scan_id", "scan_timestamp", "project", "schema_version"]
    counts = ["finding_count", "new_count", "resolved_count"]
    return df.select("path", "ord", *[text(member(e, c)).alias(c) for c in texts], *[F.try_variant_get(member(e, c), "$", "int").alias(c) for c in counts],
                     F.try_variant_get(member(e, "duration_seconds"), "$", "double").alias("duration_seconds"), F.try_variant_get(member(e, "scanner_versions"), "$", "map<string,string>").alias("scanner_versions"))


def gitlab(reports: DataFrame) -> DataFrame:
    """Findings of the vulnerability report: rule = first identifier with a value, CVE = first of that type."""
    df, e = _each(reports, listed(member(F.col("v"), "vulnerabilities"))), F.col("e")
    location, identifiers = member(e, "location"), listed(member(e, "identifiers"))
    values = F.filter(F.transform(identifiers, lambda x: F.nullif(text(member(x, "value")), F.lit(""))), lambda x: x.isNotNull())
    cves = F.filter(identifiers, lambda x: F.lower(F.coalesce(text(member(x, "type")), F.lit(""))) == "cve")
    rule = F.coalesce(F.get(values, F.lit(0)), F.nullif(text(member(location, "method")), F.lit("")), text(member(e, "id")))
    return _of(df, "gitlab", type=text(member(e, "category")), rule_id=rule, cve_id=text(member(F.get(cves, F.lit(0)), "value")), title=text(member(e, "name")),
               description=F.coalesce(text(member(e, "description")), text(member(e, "message"))), file=F.coalesce(text(member(location, "file")), F.lit("unknown")),
               line=_line(member(location, "start_line")), severity=F.coalesce(text(member(e, "severity")), F.lit("medium")), category=text(member(e, "category")))


def sarif(reports: DataFrame) -> DataFrame:
    """Results with a location of every run; error is high here, unlike in the severity filter."""
    v = F.col("v")
    nested = F.flatten(F.transform(listed(member(v, "runs")), lambda r: listed(member(r, "results"))))
    df, e = _each(reports, nested), F.col("e")
    first = F.get(listed(member(e, "locations")), F.lit(0))
    place = member(first, "physicalLocation")
    level = F.lower(F.coalesce(text(member(e, "level")), F.lit("warning")))
    severity = vocab.lookup(level, {"error": "high", "warning": "medium", "note": "low"}, "medium")
    message = member(e, "message")
    return _of(df.where(first.isNotNull()), "sarif", rule_id=text(member(e, "ruleId")), title=F.coalesce(text(member(e, "ruleId")), F.lit("Unknown")),
               description=F.coalesce(text(member(message, "text")), F.when(as_map_of(message).isNull(), text(message)), F.lit("")), file=F.coalesce(text(member(member(place, "artifactLocation"), "uri")), F.lit("unknown")),
               line=_line(member(member(place, "region"), "startLine")), severity=severity)


def syft_receipt(reports: DataFrame, admitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, dependencies) of provider reports, bound to admitted files (file, sha256).

    An artifact is a candidate if one of its locations is an admitted file. `dependency-of` edges
    point from the dependency to its user, so their ends are exchanged.
    """
    from lodestrata.operators.nested import artifacts_table, edges_table, latest_reports, objects

    latest = latest_reports(reports)
    nodes = objects(latest)
    where = F.transform(listed(member(F.col("node"), "locations")), lambda x: F.regexp_replace(text(member(x, "path")), "^/", ""))
    placed = nodes.where("entity = 'artifact'").select("report_id", F.col("parent_path").alias("path"), F.explode(F.array_distinct(where)).alias("file"))
    bound = placed.join(admitted, "file").select("report_id", "path", "file", "sha256")
    candidates = artifacts_table(nodes).join(bound, ["report_id", "path"])
    e = edges_table(latest).where("type = 'dependency-of'")
    return candidates, e.select("report_id", F.col("child").alias("parent"), F.col("parent").alias("child"))


def path_list(texts: DataFrame, column: str = "body") -> DataFrame:
    """Paths of NUL-delimited lists, empty ones left out."""
    return texts.select(F.explode(F.split(column, "\x00")).alias("path")).where("path <> ''")


def changed_lines(diffs: DataFrame) -> DataFrame:
    """(diff_id, file, line) of lines that unified diffs (diff_id, body) add or change.

    A diff is one row; its lines become an array that is folded once, keeping file and line number.
    """
    zero = F.struct(F.lit(None).cast("string").alias("file"), F.lit(0).alias("at"), F.array().cast("array<struct<file:string,line:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        named = F.regexp_replace(F.get(F.split(x, r"\s+"), F.lit(3)), "^b/", "")
        start = F.coalesce(F.expr("1") * F.try_to_number(F.nullif(F.regexp_extract(x, r"^@@[^+@]*\+(\d+)", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(1))
        header, hunk = x.startswith("diff --git"), x.startswith("@@") & s.file.isNotNull()
        added = s.file.isNotNull() & x.startswith("+") & ~x.startswith("+++")
        still = s.file.isNull() | x.startswith("\\") | (x.startswith("-") & ~x.startswith("---"))
        return F.struct(
            F.when(header, named).otherwise(s.file).alias("file"),
            F.when(header, s.at).when(hunk, start).when(still, s.at).otherwise(s.at + 1).cast("int").alias("at"),
            F.when(~header & ~hunk & added, F.concat(s.out, F.array(F.struct(s.file.alias("file"), s.at.cast("int").alias("line"))))).otherwise(s.out).alias("out"),
        )

    lines = F.split(F.regexp_replace("body", "\r\n", "\n"), "\n")
    return diffs.select("diff_id", F.inline(F.aggregate(lines, zero, step).getField("out"))).distinct()


# Text detectors as (type, severity, all of these texts or patterns).
DETECTORS = [
    ("SQL Injection", "CRITICAL", r"(?s)(?=.*\$_(GET|POST)\[)(?=.*(SELECT|UPDATE|INSERT|DELETE))"),
    ("SQL Injection", "ERROR", r"mysql_query\("),
    ("XSS", "HIGH", r"echo \$_GET\["),
    ("CSRF", "MEDIUM", r"(?is)<form(?!.*csrf)"),
    ("Command Injection", "CRITICAL", r"(?s)(exec|system|passthru|shell_exec)\s*\(\s*\$_(GET|POST)"),
    ("File Inclusion", "HIGH", r"(include|require)(_once)?\s*\(?\s*\$_(GET|POST)"),
]


def detect(files: DataFrame, detectors=DETECTORS) -> DataFrame:
    """(file, type, severity, line) of whole-file text tests: each detector is one pattern, all tested in one pass.

    `line` is the first line that the pattern matches by itself, 1 if only the whole file does.
    """
    tests = [F.when(F.col("content").rlike(p), F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity"), F.lit(p).alias("pattern"))) for t, s, p in detectors]
    hits = files.select("file", "content", F.explode(F.array_compact(F.array(*tests))).alias("d"))
    lines = F.split("content", r"\r\n|\n|\r")
    at = F.get(F.filter(F.transform(lines, lambda x, i: F.when(F.regexp_like(x, F.col("d.pattern")), i + 1)), lambda x: x.isNotNull()), F.lit(0))
    return hits.select("file", "d.type", "d.severity", F.coalesce(at, F.lit(1)).alias("line"))

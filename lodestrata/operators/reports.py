"""Findings as report texts: SARIF, the vulnerability report, stored JSON; merging and fix plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lodestrata.functions import vocab
from lodestrata.operators.findings import first_per_key

#: Optional members that are left out of a stored finding when they are empty.
OPTIONAL = ["otel_attributes", "fix_type", "fix_complexity", "effort_mins", "affected_symbol", "ai_context", "sla_deadline"]


def sarif_results(findings: DataFrame) -> DataFrame:
    """(ord columns kept, result): one SARIF result per finding; packages and images become logical locations."""
    virtual = F.col("file").rlike("^(dependency|image):")
    physical = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    logical = F.struct(F.array(F.struct(F.col("file").alias("fullyQualifiedName"))).alias("logicalLocations"))
    place = F.when(virtual, F.to_json(F.array(logical))).otherwise(F.to_json(F.array(physical)))
    head = F.to_json(F.struct(F.col("rule_id").alias("ruleId"), vocab.mapped_severity(F.col("severity"), "sarif_level").alias("level"), F.struct(F.col("message").alias("text")).alias("message")))
    result = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"locations":'), place, F.lit("}"))
    return findings.withColumn("result", result)


def sarif_rules(findings: DataFrame, order: Column) -> DataFrame:
    """(rule_id, severity, message): the first definition of each rule in the order of the input."""
    return first_per_key(findings, ["rule_id"], order, ["severity", "message"])


def vulnerability_rows(findings: DataFrame) -> DataFrame:
    """(finding_id, vulnerability): one object of the vulnerability report per finding."""
    body = F.struct(
        F.col("finding_id").alias("id"), vocab.stored_category("category").alias("category"), F.col("rule_id").alias("name"), F.col("message"),
        vocab.lookup(F.lower("severity"), {**{s: s for s in vocab.SEVERITIES}, "info": "info"}, "medium").alias("severity"),
        F.struct(F.col("file"), F.col("line").alias("start_line")).alias("location"), F.array(F.struct(F.lit("rule").alias("type"), F.col("rule_id").alias("name"), F.col("rule_id").alias("value"))).alias("identifiers"),
    )
    return findings.select("finding_id", F.to_json(body).alias("vulnerability"))


def stored_rows(findings: DataFrame) -> DataFrame:
    """(finding): JSON of each finding; optional members that are null or empty are absent."""
    columns = [F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) if c in OPTIONAL else F.col(c) for c in findings.columns]
    return findings.select(F.to_json(F.struct(*columns)).alias("finding"))


def merged(reports: Sequence[DataFrame]) -> DataFrame:
    """All findings of several reports, columns by name; `source` keeps which report came first."""
    out = None
    for i, r in enumerate(reports):
        r = r.withColumn("source", F.lit(i))
        out = r if out is None else out.unionByName(r, allowMissingColumns=True)
    return out


def upserted(stored: DataFrame, delivered: DataFrame, key: str, order: str) -> DataFrame:
    """The table after an upsert by key: the delivered row wins, of several the last in order."""
    names = [c for c in stored.columns if c != key]
    last = F.max(F.struct("_new", order, *[c for c in names if c != order]))
    both = stored.withColumn("_new", F.lit(0)).unionByName(delivered.select(*stored.columns).withColumn("_new", F.lit(1)))
    return both.groupBy(key).agg(last.alias("_l")).select(key, *[F.col(f"_l.{c}").alias(c) for c in names]).select(*stored.columns)


def fix_plan(fixes: DataFrame, order: Column) -> DataFrame:
    """(ecosystem, first, packages, n_cves): fixes per ecosystem, in the order the ecosystems were first seen."""
    return fixes.groupBy("ecosystem").agg(
        F.min(order).alias("first"), F.array_join(F.sort_array(F.collect_set("package")), ", ").alias("packages"), F.count_distinct("cve_id").alias("n_cves")
    )


def bumped(line: Column, ecosystem: str, package: Column, version: Column) -> Column:
    """A manifest line with the package's version raised; other lines stay. Range signs of npm stay."""
    name = F.concat(F.lit(r"\Q"), package, F.lit(r"\E"))
    made = {
        "pypi": (F.concat(F.lit(r"^(\s*"), name, F.lit(r")\s*(==|>=|~=|<=|<|>)\s*[^\s;#,]+")), F.concat(F.lit("$1>="), version)),
        "npm": (F.concat(F.lit(r'^(\s*"'), name, F.lit(r'"\s*:\s*"(?:\^|~|>=|>)?)[^"]*(")')), F.concat(F.lit("${1}"), version, F.lit("$2"))),
        "golang": (F.concat(F.lit(r"^(\s*(?:require\s+)?"), name, F.lit(r"\s+)v?\S+")), F.concat(F.lit("${1}v"), version)),
        "gem": (F.concat(F.lit(r"^(\s*gem\s+['\"]"), name, F.lit(r"['\"])(?:\s*,\s*['\"][^'\"]*['\"])?")), F.concat(F.lit("$1, '~> "), version, F.lit("'"))),
    }
    pattern, put = made[ecosystem]
    if ecosystem in ("npm", "golang"):
        # a version begins with a digit, which a reference to a group would swallow, so the parts are joined
        group = lambda n: F.call_function("regexp_extract", line, pattern, F.lit(n))
        before, after = group(1), (group(2) if ecosystem == "npm" else F.lit(""))
        rest = F.regexp_replace(line, pattern, "")
        return F.when(before != "", F.concat(before, F.lit("v") if ecosystem == "golang" else F.lit(""), version, after, rest)).otherwise(line)
    return F.regexp_replace(line, pattern, put)

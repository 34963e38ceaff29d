"""Operators over finding rows: cleaning, suppression, tracking, baselines, order and summaries.

Rows come as (scan_id, finding_id, rule_id, file, line, severity, category, ...). Rule and policy
lists are configuration, a few dozen entries: they fold into one expression, so they cost no join.
Everything keyed on data (other scans, baselines, diffs) is an equi join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestrata.functions import vocab
from lodestrata.functions.ids import compute_finding_id, issue_fingerprint, linefree_fingerprint, normalize_path
from lodestrata.functions.paths import ancestors, glob_pattern
from lodestrata.functions.text import key


def cleaned(findings: DataFrame) -> DataFrame:
    """One row per (scan_id, finding_id): the latest delivery, values trimmed and in lower case.

    Missing ids are computed from rule, path and line. Rows without a scan are left out. The latest
    is taken by a combined maximum of one struct, not by sorting a window.
    """
    one = findings.where("scan_id is not null").select(
        "scan_id",
        F.coalesce(key("finding_id"), compute_finding_id(F.col("rule_id"), F.col("file"), F.col("line"))).alias("finding_id"),
        F.struct(
            "ingested_at",
            F.coalesce(key("rule_id"), F.lit("")).alias("rule_id"),
            normalize_path("file").alias("file"),
            F.coalesce("line", F.lit(0)).alias("line"),
            F.coalesce(key("severity"), F.lit("")).alias("severity"),
            F.coalesce(key("category"), F.lit("")).alias("category"),
            F.coalesce(key("trend"), F.lit("")).alias("trend"),
            "scan_timestamp",
            "payload",
        ).alias("_v"),
    )
    latest = one.groupBy("scan_id", "finding_id").agg(F.max("_v").alias("_v"))
    return latest.select("scan_id", "finding_id", "_v.*")


@dataclass(frozen=True)
class IgnoreRule:
    """A suppression: any of its matchers is enough, and only while it is active."""

    rule_id: str | None = None
    file_path: str | None = None
    message: str | None = None
    cve_id: str | None = None
    permanent: bool = False
    until: str | None = None
    reason: str = ""

    def condition(self, now: Column, columns: dict[str, Column]) -> Column:
        empty = lambda c: F.coalesce(c, F.lit(""))
        tests = []
        if self.rule_id:
            tests.append(empty(columns["rule_id"]) == self.rule_id)
        if self.cve_id and "cve_id" in columns:
            tests.append(empty(columns["cve_id"]) == self.cve_id)
        if self.file_path:
            tests.append((empty(columns["file"]) != "") & columns["file"].rlike(glob_pattern(self.file_path)))
        if self.message:
            tests.append(F.lower(empty(columns["message"])).contains(self.message.lower()))
        hit = F.lit(False)
        for t in tests:
            hit = hit | t
        active = F.lit(True) if self.permanent else now < F.to_timestamp(F.lit(self.until)) if self.until else F.lit(False)
        return hit & active


def suppression(rules: Sequence[IgnoreRule], now: Column, columns: dict[str, Column]) -> Column:
    """Ordinal of the first rule that matches, null if none does: one CASE, no join."""
    out = None
    for i, rule in enumerate(rules):
        condition = F.coalesce(rule.condition(now, columns), F.lit(False))
        out = F.when(condition, i) if out is None else out.when(condition, i)
    return F.lit(None).cast("int") if out is None else out


def tracked(current: DataFrame, previous: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Current findings with trend, first_seen and age against the previous ones.

    `previous` carries `first_seen`; of several rows of one id the one seen last counts. A first
    seen date that is missing starts now. Ages are whole UTC days, at least 0.
    """
    keys = [*by, "finding_id"]
    last = F.max(F.struct("scan_timestamp", "first_seen"))  # a struct, so that a null time loses instead of hiding its row
    before = previous.groupBy(*keys).agg(last.alias("_last")).select(*keys, F.col("_last.first_seen").alias("_first"), F.lit(True).alias("_known"))
    out = current.join(before, keys, "left")
    first = F.coalesce("_first", "scan_timestamp")
    return out.withColumns(
        {
            "trend": F.when(F.col("_known"), "unchanged").otherwise("new"),
            "first_seen": first,
            "age_days": F.greatest(F.datediff("scan_timestamp", first), F.lit(0)),
        }
    ).drop("_first", "_known")


def resolved(current: DataFrame, previous: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct ids of the previous scan that the current one lacks."""
    keys = [*by, "finding_id"]
    return previous.select(*keys).distinct().join(current.select(*keys), keys, "left_anti")


def not_in_baseline(findings: DataFrame, baseline: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Findings that the baseline of the same `by` knows neither by exact nor by line-free fingerprint.

    The disjunction is two hash joins whose flags are combined; written as one OR condition it
    would be a nested loop.
    """
    exact = compute_finding_id(F.col("rule_id"), F.col("file"), F.coalesce("line", F.lit(1)))
    loose = linefree_fingerprint(F.col("rule_id"), F.col("file"))
    marked = findings.withColumns({"_exact": exact, "_loose": loose})
    a = baseline.select(*by, exact.alias("_exact")).distinct().withColumn("_in_exact", F.lit(True))
    b = baseline.select(*by, loose.alias("_loose")).distinct().withColumn("_in_loose", F.lit(True))
    out = marked.join(a, [*by, "_exact"], "left").join(b, [*by, "_loose"], "left")
    return out.where("_in_exact is null and _in_loose is null").drop("_exact", "_loose", "_in_exact", "_in_loose")


def by_severity(findings: DataFrame, least: str) -> DataFrame:
    return findings.where(vocab.at_least("severity", least))


def in_display_order(findings: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """Most severe first; ties keep the order of arrival, which must be a column."""
    return findings.orderBy(vocab.display_order("severity"), *arrival)


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Column, names: Sequence[str]) -> DataFrame:
    """The row that comes first of each key, by a combined minimum."""
    return rows.groupBy(*keys).agg(F.min(F.struct(order, *names)).alias("_m")).select(*keys, *[F.col(f"_m.{n}").alias(n) for n in names])


def severity_counts(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in vocab.SEVERITIES]
    return (findings.groupBy(*by) if by else findings).agg(*counts)


def gauge(findings: DataFrame) -> DataFrame:
    """(severity, category, project, n), blanks as unknown."""
    named = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias(c)
    return findings.select(named("severity"), named("category"), named("project")).groupBy("severity", "category", "project").agg(F.count(F.lit(1)).alias("n"))


def exposition(gauges: DataFrame) -> DataFrame:
    """Lines of the text format of a metrics endpoint, in order."""
    quoted = lambda c: F.regexp_replace(F.regexp_replace(F.col(c), r"([\\\"])", r"\\$1"), "\n", r"\\n")
    line = F.format_string('findings_total{severity="%s",category="%s",project="%s"} %d', quoted("severity"), quoted("category"), quoted("project"), "n")
    return gauges.orderBy("severity", "category", "project").select(line.alias("line"))


def snapshot(findings: DataFrame) -> DataFrame:
    """(category, severity, n) of the whole vocabulary, zeros included; null stands for all."""
    spark = findings.sparkSession
    levels, kinds = [*vocab.SEVERITIES, "unknown"], vocab.GATE_CATEGORIES
    counted = findings.select(vocab.gate_category("category").alias("category"), vocab.gate_severity("severity").alias("severity"))
    counted = counted.groupingSets([[], ["severity"], ["category"], ["category", "severity"]], "category", "severity").agg(F.count(F.lit(1)).alias("n"))
    cells = [(c, s) for c in [None, *kinds] for s in [None, *levels]]
    frame = spark.createDataFrame(cells, "category string, severity string")
    return _dense(frame, counted, ["category", "severity"])


def _dense(frame: DataFrame, counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`frame` is the fixed vocabulary, so it is the side that is broadcast or hashed."""
    a, b = frame.alias("a"), counted.alias("b")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, on, "left").select(*[f"a.{k}" for k in keys], F.coalesce("b.n", F.lit(0)).alias("n"))


def cohorts(findings: DataFrame, baseline_ids: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(category, cohort, severity, n), dense: what is new against a baseline of finding ids of the same `by`."""
    spark = findings.sparkSession
    known = baseline_ids.select(*by, "finding_id").distinct().withColumn("_old", F.lit(True))
    counted = findings.join(known, [*by, "finding_id"], "left").select(
        vocab.gate_category("category").alias("category"),
        F.when(F.col("_old"), "existing").otherwise("new").alias("cohort"),
        vocab.gate_severity("severity").alias("severity"),
    )
    counted = counted.groupBy("category", "cohort", "severity").agg(F.count(F.lit(1)).alias("n"))
    cells = [(c, h, s) for c in vocab.GATE_CATEGORIES for h in ("new", "existing") for s in [*vocab.SEVERITIES, "unknown"]]
    return _dense(spark.createDataFrame(cells, "category string, cohort string, severity string"), counted, ["category", "cohort", "severity"])


def violations(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_no, action, n, max_count) of rules (rule_no, severity, category, max_count, action) beyond their limit.

    Findings are counted once per (severity, category), per each alone, and in all: a rule that names
    neither, one or both is then an equality on the level it names. What meets the rules is as small
    as the vocabulary, however many findings there are. `ignore` rules are skipped; a limit that is
    missing is 0; the limit itself is still allowed.
    """
    named = findings.select(F.coalesce("severity", F.lit("")).alias("_s"), F.coalesce(vocab.policy_category("category"), F.lit("")).alias("_c"))
    counts = named.groupingSets([[], ["_s"], ["_c"], ["_s", "_c"]], "_s", "_c").agg(F.count(F.lit(1)).alias("n"))
    active = rules.where("action <> 'ignore'").select("rule_no", "action", F.coalesce("max_count", F.lit(0)).alias("max_count"), "severity", "category")
    met = active.join(counts, active.severity.eqNullSafe(counts._s) & active.category.eqNullSafe(counts._c))
    return met.where("n > max_count").select("rule_no", "action", "n", "max_count")


def control_coverage(findings: DataFrame, controls: DataFrame) -> DataFrame:
    """(control_id, n) of every control, zeros included; `controls` has (control_id, categories).

    Findings are counted per category before they meet the controls.
    """
    counts = findings.groupBy(vocab.compliance_category(F.col("category")).alias("category")).agg(F.count(F.lit(1)).alias("_n"))
    each = controls.select("control_id", F.explode("categories").alias("category"))
    return each.join(counts, "category", "left").groupBy("control_id").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))


def unmapped(findings: DataFrame, controls: DataFrame) -> DataFrame:
    """(category, n) of findings that no control covers."""
    counts = findings.groupBy(vocab.compliance_category(F.col("category")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(controls.select(F.explode("categories").alias("category")), "category", "left_anti")


def on_changed_lines(findings: DataFrame, changed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Findings whose (file, line) is in the diff of the same `by`; both sides are keyed on file and line, so no file is hot."""
    on = [*by, "file", "line"]
    return findings.where("file <> ''").join(changed.select(*on).distinct(), on, "left_semi")


def comments(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One comment per file: its first line, how many findings of each severity, the body in fixed order."""
    rank = vocab.display_order("severity")
    item = F.struct(rank.alias("rank"), "line", "rule_id")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: F.concat(F.lit("- "), x.rule_id, F.lit(" (line "), x.line.cast("string"), F.lit(")"))), "\n")
    return findings.groupBy(*by, "file").agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("n"), body.alias("body"))


def issue_plan(findings: DataFrame, known: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, fingerprint, action, priority): create or skip for critical and high findings, close what is gone.

    `known` has (by, fingerprint) of the issues that exist.
    """
    on = [*by, "fingerprint"]
    now = findings.where(F.col("severity").isin("critical", "high")).withColumn("fingerprint", issue_fingerprint(F.col("rule_id"), F.col("file")))
    now = now.groupBy(*on).agg(F.min(vocab.display_order("severity")).alias("_rank"))
    have = known.select(*on).distinct().withColumn("_have", F.lit(True))
    action = F.when(F.col("_rank").isNull(), "close").when(F.col("_have"), "skip").otherwise("create")
    priority = F.when(F.col("_rank") == 0, "Highest").when(F.col("_rank") == 1, "High")
    return now.join(have, on, "full_outer").select(*on, action.alias("action"), priority.alias("priority"))


def overdue(assigned: DataFrame, now: Column) -> DataFrame:
    """Ownership rows (assigned_at, sla_days) past their deadline: elapsed days, fractions counted, beyond it."""
    elapsed = (F.unix_micros(now) - F.unix_micros(F.col("assigned_at").cast("timestamp"))) / F.lit(86_400_000_000)
    return assigned.where(elapsed > F.col("sla_days"))


def repeated(findings: DataFrame) -> DataFrame:
    """(scan_id, rule_id, file, line, n) of findings listed more than once."""
    return findings.groupBy("scan_id", "rule_id", "file", "line").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def in_scope(findings: DataFrame, units: DataFrame) -> DataFrame:
    """Findings under any of the units (unit): a prefix search by equality on every directory above."""
    above = findings.withColumn("_under", F.explode(ancestors(F.col("file"))))
    hit = above.join(units.select(F.col("unit").alias("_under")).distinct(), "_under", "left_semi")
    return hit.dropDuplicates([c for c in ("scan_id", "finding_id") if c in findings.columns]).drop("_under")


def budget_fold(parts: DataFrame, cap: int, by: str) -> DataFrame:
    """Parts (by, ord, size) in order: one that would exceed the cap is discarded and costs nothing.

    Sequential by nature, so a fold over one array of each plan's parts: none is cut, and a plan's parts
    must be few enough for a task (the rules of one scan: some hundreds).
    """
    items = F.sort_array(F.collect_list(F.struct("ord", "size")))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<ord:int,kept:boolean>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        fits = state.used + x.size <= cap
        return F.struct((state.used + F.when(fits, x.size).otherwise(0)).cast("long").alias("used"), F.concat(state.out, F.array(F.struct(x.ord.cast("int").alias("ord"), fits.alias("kept")))).alias("out"))

    return parts.groupBy(by).agg(F.aggregate(items, zero, step).alias("s")).select(by, F.inline("s.out"))


def scan_to_scan(counts: DataFrame) -> DataFrame:
    """Counts per scan (project, at, n) with the change against the scan before: windowed per project over scans only."""
    w = W.partitionBy("project").orderBy("at", "scan_id")
    return counts.withColumn("change", F.col("n") - F.lag("n").over(w))

"""Stored findings and scans in order, their derived attributes, and checks that refuse instead of cutting.

Positions in an order are numbered without a task per group: rows are range-sorted, each partition numbers its own, and
the counts of the partitions before are added. Defined results: nulls come first in an order unless its expression says
otherwise; repeated rows are numbered apart; an empty table has no positions; a check on an empty table passes.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType

from lodestrata.functions import vocab
from lodestrata.functions.ids import canonical_json
from lodestrata.storage import Workspace

# Bounds of a finding and of a component's figures.
MAX_FINDING_NODES, MAX_FINDING_DEPTH, MAX_FINDING_BYTES = 4096, 8, 64 * 1024
MAX_COMPONENT_SECONDS, MAX_PEAK_RSS_BYTES = 1800, 1 << 40
# What a disposition of an input says about its enumeration; others leave it unknown.
OUTCOMES = {"parsed": "complete", "unresolved": "partial", "bounded-omission": "partial", "failed": "failed"}


def positions(rows: DataFrame, by: Sequence[str], order: Sequence[Column], keep: Sequence[str], name: str = "position") -> DataFrame:
    """(by, keep, name): the 0-based position of each row in the order within `by`; `order` should tell rows apart."""
    keys = [f"_o{i}" for i in range(len(order))]
    keyed = rows.select(*by, *keep, *[c.alias(k) for c, k in zip(order, keys)])
    work = Workspace(rows.sparkSession, "positions")
    laid = work.cut(keyed.repartitionByRange(*by, *keys).withColumn("_part", F.spark_partition_id()), "laid")
    counts = laid.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))  # a row per partition
    starts = counts.select(*[F.col(b).alias(f"_{b}") for b in by], F.col("_part").alias("_at"), F.coalesce(before, F.lit(0)).alias("_start"))
    inner = F.row_number().over(W.partitionBy(*by, "_part").orderBy(*keys))
    same = F.col("_part") == F.col("_at")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    return laid.withColumn("_i", inner).join(starts, same).select(*by, *keep, (F.col("_start") + F.col("_i") - 1).alias(name))


BLOCK = 1024  # rows, or digests of blocks, under one digest


def ordered_digest(rows: DataFrame, by: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """(by, n, digest) of rows in their order: a tree of SHA-256 digests over blocks of `BLOCK` neighbours.

    The rows of a group never meet in one task; a group of one block ends with that block's digest, so a digest depends on
    its own rows and their order alone.
    """
    body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    level = positions(rows.withColumn("_d", F.sha2(body, 256)), by, order, ["_d"], "_at")
    sizes = level.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    work = Workspace(rows.sparkSession, "digests")
    while True:
        inside = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_d"))), lambda x: x["_d"]), "")
        alone = F.count(F.lit(1)) == 1
        # a digest that is alone at the top stays; below the top every block is hashed
        digest = F.when(F.max("_top") & alone, F.max("_d")).otherwise(F.sha2(inside, 256))
        top = level if "_top" in level.columns else level.withColumn("_top", F.lit(False))
        level = top.groupBy(*by, F.floor(F.col("_at") / BLOCK).alias("_at")).agg(digest.alias("_d")).withColumn("_top", F.lit(True))
        level = work.cut(level, "level")
        if level.where("_at > 0").isEmpty():
            a, b = level.select(*by, F.col("_d").alias("digest")), sizes
            on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by]
            return a.alias("a").join(b.alias("b"), on).select(*[f"a.{k}" for k in by], "n", "digest")


def stored_order(findings: DataFrame) -> DataFrame:
    """(scan_id, finding_id, position) of the findings of each scan by file and line."""
    return positions(findings, ["scan_id"], [F.col("file"), F.col("line"), F.col("finding_id")], ["finding_id"])


def newest_first(scans: DataFrame) -> DataFrame:
    """(project, scan_id, position) of the scans of each project from the newest on; scans without a time come last."""
    at = F.coalesce(-F.unix_micros(F.col("scan_timestamp").cast("timestamp")), F.lit((1 << 63) - 1))
    return positions(scans, ["project"], [at, F.col("scan_id")], ["scan_id"])


def of_id(rows: DataFrame, column: str, value: str) -> DataFrame:
    """The rows of one id; the filter reaches the scan."""
    return rows.where(F.col(column) == value)


def otel_attributes(findings: DataFrame) -> DataFrame:
    """(finding_id, attributes): a map without null and empty values."""
    text = lambda c: F.col(c).cast("string")
    pairs = {
        "scan_id": text("scan_id"), "finding_id": text("finding_id"), "rule_id": text("rule_id"), "severity": text("severity"),
        "category": F.coalesce(text("category"), F.lit("unknown")),
    }
    named = [x for k, v in pairs.items() for x in (F.lit(f"finding.{k}"), v)] + [F.lit("code.filepath"), text("file"), F.lit("code.lineno"), F.coalesce(text("line"), F.lit("0"))]
    return findings.select("finding_id", F.map_filter(F.create_map(*named), lambda _, v: v.isNotNull() & (v != "")).alias("attributes"))


def issue_summary(severity: Column, title: Column, file: Column) -> Column:
    """`[SEVERITY] title — file`; a missing severity is unknown, a missing title a security finding."""
    head = F.concat(F.lit("["), F.upper(F.coalesce(F.nullif(severity, F.lit("")), F.lit("unknown"))), F.lit("] "), F.coalesce(title, F.lit("Security Finding")))
    return F.when(F.coalesce(file, F.lit("")) != "", F.concat(head, F.lit(" — "), file)).otherwise(head)


def _size(body: str) -> int | None:
    try:
        finding = json.loads(body)
    except (ValueError, RecursionError):
        return None
    if not isinstance(finding, dict):
        return None
    name, line, file = finding.get("rule_id") or finding.get("title"), finding.get("line", 1), finding.get("file")
    if not isinstance(finding.get("scanner"), str) or not isinstance(name, str) or not name or not isinstance(file, str) or not file:
        return None
    if type(line) is not int or line < 1:
        return None
    level, nodes = [finding], 0
    for depth in range(MAX_FINDING_DEPTH + 2):
        nodes += len(level)
        if nodes > MAX_FINDING_NODES or (level and depth > MAX_FINDING_DEPTH):
            return None
        if any(isinstance(x, float) and not math.isfinite(x) for x in level):
            return None
        level = [y for x in level if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]
        if not level:
            break
    size = len(canonical_json(finding).encode())
    return size if size <= MAX_FINDING_BYTES else None


@F.pandas_udf(LongType())
def finding_size(body: pd.Series) -> pd.Series:
    """Bytes of the canonical JSON of a finding; null where it is too large, too deep or lacks scanner, name, file or line."""
    return pd.Series([None if b is None else _size(b) for b in body], dtype="Int64")


def input_outcome(disposition: Column, ecosystem: Column, digest: Column, parser: Column, refused: Column | None = None) -> Column:
    """What an input says about how much of its packages was enumerated."""
    known = ecosystem.isNotNull() & digest.isNotNull() & parser.isNotNull()
    if refused is not None:
        known = known & ~refused
    return F.when(known, vocab.lookup(F.coalesce(disposition, F.lit("")), OUTCOMES, "unknown")).otherwise("unknown")


def component_metric(elapsed: Column, before: Column, after: Column) -> Column:
    """{elapsed_seconds, memory, peak_rss_bytes}: null for a time out of bounds; memory is unavailable unless the peak rose."""
    rose = F.coalesce((before < after) & (after <= MAX_PEAK_RSS_BYTES), F.lit(False))
    metric = F.struct(
        F.round(elapsed, 3).alias("elapsed_seconds"), F.when(rose, "partial").otherwise("unavailable").alias("memory"), F.when(rose, after).alias("peak_rss_bytes")
    )
    return F.when((elapsed >= 0) & (elapsed <= MAX_COMPONENT_SECONDS) & ~F.isnan(elapsed), metric)


def aged(findings: DataFrame, days: int = 30) -> DataFrame:
    """Findings open for more than `days` days; an unknown age is no age."""
    return findings.where(F.col("age_days") > days)


def secrets_check(findings: DataFrame) -> DataFrame:
    """One row: how many secrets there are, in how many files."""
    secrets = findings.where(F.col("scanner") == "gitleaks")
    return secrets.agg(F.count(F.lit(1)).alias("secrets"), F.count_distinct("file").alias("files"))


def legacy_gate_category(category: Column, kind: Column, scanner: Column) -> Column:
    """Category, else type, else scanner; what is no member is other."""
    said = F.lower(F.coalesce(*[F.nullif(c, F.lit("")) for c in (category, kind, scanner)], F.lit("")))
    return F.when(said.isin(*vocab.GATE_CATEGORIES), said).otherwise("other")


def parity(legacy: DataFrame, gate: DataFrame) -> DataFrame:
    """(rule_no, action, in_legacy, in_gate) of rules on which two verdicts differ; no row means parity.

    Both have (rule_no, action) of the rules that fail or warn.
    """
    on = ["rule_no", "action"]
    a = legacy.where("action in ('fail', 'warn')").select(*on).distinct().withColumn("in_legacy", F.lit(True))
    b = gate.where("action in ('fail', 'warn')").select(*on).distinct().withColumn("in_gate", F.lit(True))
    both = a.join(b, on, "full_outer").select(*on, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("in_legacy", "in_gate")])
    return both.where("in_legacy <> in_gate")


def refuse_beyond(rows: DataFrame, most: int, what: str) -> DataFrame:
    """The rows as they are, or an error if there are more than `most`: a bound refuses, it never cuts."""
    n = rows.agg(F.count(F.lit(1))).scalar()
    return rows.where(F.when(n > most, F.raise_error(F.lit(f"{what} exceed {most}")).isNull()).otherwise(True))


def in_both(covered: DataFrame, deleted: DataFrame, path: str = "path") -> DataFrame:
    """Paths that are said to be covered and deleted; a valid scope has none."""
    return covered.select(path).distinct().join(deleted.select(path), path, "left_semi")


def duplicate_ids(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, finding_id, n) of ids that occur more than once; a gate refuses its input if there is one."""
    return findings.groupBy(*by, "finding_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")

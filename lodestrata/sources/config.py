"""Configuration as rows, and what is wrong with it.

Files are small and are read on the driver; checking is a query, so that thousands of configurations
can be checked at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestrata.functions.text import key
from lodestrata.functions.vocab import SEVERITIES
from lodestrata.operators.findings import IgnoreRule

POLICY_CATEGORIES = ["secrets", "sast", "iac", "cve", "dependency_scanning", "container_images"]
ACTIONS = ["fail", "warn", "ignore"]
IGNORE_SCHEMA = "ord int, rule_id string, file_path string, message string, cve_id string, permanent boolean, until string, reason string"
POLICY_SCHEMA = "ord int, severity string, category string, max_count string, action string"


def load(text: str) -> dict:
    """The parsed YAML of a configuration; {} for an empty one."""
    import yaml

    data = yaml.safe_load(text) or {}
    if not isinstance(data, dict):
        raise ValueError("a configuration is a mapping")
    return data


def ignore_rules(data: dict) -> list[IgnoreRule]:
    known = set(IgnoreRule.__dataclass_fields__)
    return [IgnoreRule(**{k: str(v) if k == "until" and v is not None else v for k, v in r.items() if k in known}) for r in data.get("ignore", [])]


def frames(spark: SparkSession, data: dict) -> tuple[DataFrame, DataFrame]:
    """(ignore rules, policy rules) with their position."""
    text = lambda x: None if x is None else str(x)
    ignored = [(i, *[text(r.get(k)) for k in ("rule_id", "file_path", "message", "cve_id")], bool(r.get("permanent", False)), text(r.get("until")), text(r.get("reason"))) for i, r in enumerate(data.get("ignore", []))]
    policy = [(i, *[text(r.get(k)) for k in ("severity", "category", "max_count", "action")]) for i, r in enumerate(data.get("policy", []))]
    return spark.createDataFrame(ignored, IGNORE_SCHEMA), spark.createDataFrame(policy, POLICY_SCHEMA)


def _problems(rows: DataFrame, where: str, tests: dict) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in tests.items()]))
    return rows.select(F.lit(where).alias("section"), "ord", F.explode(found).alias("problem"))


def ignore_problems(rules: DataFrame) -> DataFrame:
    """(section, ord, problem) of suppressions that match nothing, never end or can't be dated, or give no reason."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    matcher = F.lit(True)
    for c in ("rule_id", "file_path", "message", "cve_id"):
        matcher = matcher & blank(c)
    return _problems(rules, "ignore", {
        "no-matcher": matcher, "no-end": ~F.col("permanent") & blank("until"),
        "bad-date": ~blank("until") & F.coalesce(F.try_to_timestamp("until"), F.try_to_timestamp("until", F.lit("yyyy-MM-dd"))).isNull(), "no-reason": blank("reason"),
    })


def policy_problems(rules: DataFrame) -> DataFrame:
    """(section, ord, problem) of policy rules with values outside their vocabularies or a limit that is no whole number."""
    severity, category, action = key("severity"), key("category"), key("action")
    return _problems(rules, "policy", {
        "bad-severity": severity.isNotNull() & ~severity.isin(*SEVERITIES), "bad-category": category.isNotNull() & ~category.isin(*POLICY_CATEGORIES),
        "no-action": action.isNull(), "bad-action": action.isNotNull() & ~action.isin(*ACTIONS),
        "bad-limit": F.col("max_count").isNotNull() & F.coalesce(F.col("max_count").cast("string").try_cast("int") < 0, F.lit(True)),
    })

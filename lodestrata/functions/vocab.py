"""Severity and category vocabularies. Each consumer keeps its own: they differ on purpose."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from lodestrata.functions.text import trimmed

# Fixed values.
SEVERITIES = ["critical", "high", "medium", "low"]
STORED_CATEGORIES = ["secrets", "sast", "iac", "dependency", "container", "license", "unknown"]
STORED_ALIASES = {
    "hardcoded-secret": "secrets", "secret": "secrets", "secret_detection": "secrets", "secret-detection": "secrets",
    "dependency_scanning": "dependency", "container_scanning": "container", "container-scanning": "container",
    "container_images": "container", "image": "container",
}
COMPLIANCE_ALIASES = {
    "secret_detection": "secrets", "secrets": "secrets", "sast": "sast", "dast": "dast", "dependency_scanning": "dependency_scanning",
    "container_scanning": "dependency_scanning", "container": "dependency_scanning", "cve": "cve", "iac": "iac",
    "infrastructure as code": "iac", "license_compliance": "license_compliance", "dependency": "dependency_scanning",
}
CONTAINER_SPELLINGS = ["container_scanning", "container-scanning", "container", "container_images", "image"]
GATE_FAMILIES = {
    "container_images": CONTAINER_SPELLINGS,
    "secrets": ["hardcoded-secret", "hardcoded_secret", "secret", "secrets", "secret-detection", "secret_detection", "secretdetection", "secret-scanning", "secret_scanning"],
    "sast": ["static-analysis", "static_analysis", "code", "sast"],
    "iac": ["infrastructure-as-code", "infrastructure_as_code", "iac"],
    "dependency_scanning": ["dependency", "dependencies", "dependency-scanning", "dependency_scanning", "sca"],
}
GATE_CATEGORIES = ["secrets", "sast", "iac", "cve", "dependency_scanning", "container_images", "other"]
SEVERITY_MAPS = {
    "gitleaks": {"critical": "critical", "high": "high", "medium": "medium", "low": "low", "info": "info"},
    "kics_report": {"high": "high", "medium": "medium", "low": "low", "info": "info"},
    "kics": {"HIGH": "high", "MEDIUM": "medium", "LOW": "low"},
    "grype": {"Critical": "critical", "High": "high", "Medium": "medium", "Low": "low", "Negligible": "info", "Unknown": "medium"},
    "php": {"critical": "critical", "error": "high", "high": "high", "warning": "medium", "medium": "medium", "low": "low", "info": "info"},
    "semgrep": {"error": "high", "warning": "medium", "info": "low"},
    "sarif_level": {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"},
    "from_sarif": {"error": "critical", "warning": "medium", "note": "low"},
    "issue_priority": {"critical": "Highest", "high": "High", "medium": "Medium", "low": "Low"},
}
SEVERITY_DEFAULTS = {"sarif_level": "warning", "issue_priority": "Medium"}
CASE_SENSITIVE = {"kics", "grype"}
RANKS = {"critical": 4, "high": 3, "medium": 2, "low": 1}
REPORT_RANKS = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
ORDER = {"critical": 0, "high": 1, "medium": 2, "low": 3}
DEFAULT_SLA_DAYS = {"critical": 7, "high": 30, "medium": 90, "low": 180}


def lookup(c: Column, table: dict, default=None) -> Column:
    """Value of a small fixed table, as one map literal; null if absent and no default is given."""
    found = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])[c]
    return found if default is None else F.coalesce(found, F.lit(default))


def _word(c: Column | str) -> Column:
    return F.lower(trimmed(c))


def stored_category(c: Column | str) -> Column:
    """The category kept at storage: a member, else its alias, else unknown."""
    k = _word(c)
    return F.when(k.isin(*STORED_CATEGORIES), k).otherwise(lookup(k, STORED_ALIASES, "unknown"))


def compliance_category(category: Column, kind: Column | None = None) -> Column:
    """Category, else type; aliases resolved, anything else passes in lower case."""
    k = F.lower(F.coalesce(F.nullif(trimmed(category), F.lit("")), *([trimmed(kind)] if kind is not None else []), F.lit("")))
    return F.coalesce(lookup(k, COMPLIANCE_ALIASES), k)


def policy_category(c: Column | str) -> Column:
    """Only the container spellings fold; null stays null."""
    k = _word(c)
    return F.when(k.isin(*CONTAINER_SPELLINGS), "container_images").otherwise(k)


def gate_category(c: Column | str, cve: Column | None = None) -> Column:
    """Five families fold; a CVE promotes only what is left; the rest is other."""
    k = F.coalesce(_word(c), F.lit(""))
    out = F.lit(None)
    for family, spellings in GATE_FAMILIES.items():
        out = F.coalesce(out, F.when(k.isin(*spellings), family))
    left = F.lit("other") if cve is None else F.when(F.coalesce(cve, F.lit("")) != "", "cve").otherwise("other")
    return F.coalesce(out, left)


def gate_severity(c: Column | str) -> Column:
    k = _word(c)
    return F.when(k.isin(*SEVERITIES), k).otherwise("unknown")


def mapped_severity(c: Column, scanner: str) -> Column:
    k = c if scanner in CASE_SENSITIVE else F.upper(c) if scanner == "kics_upper" else F.lower(c)
    return lookup(F.coalesce(k, F.lit("")), SEVERITY_MAPS[scanner], SEVERITY_DEFAULTS.get(scanner, "medium"))


def semgrep_report_severity(level: Column, security: Column) -> Column:
    """Level and the rule's own security severity together."""
    s, high = F.upper(F.coalesce(level, F.lit(""))), F.lower(F.coalesce(security, F.lit(""))) == "high"
    return F.when(high & (s == "ERROR"), "critical").when(high, "high").otherwise(mapped_severity(s, "semgrep"))


def semgrep_severity(level: Column, security: Column) -> Column:
    own = F.nullif(F.lower(F.coalesce(security, F.lit(""))), F.lit(""))
    s = F.upper(F.coalesce(level, F.lit("")))
    return F.coalesce(own, F.when(s == "ERROR", "high").otherwise("medium"))


def severity_rank(c: Column | str) -> Column:
    """4 to 1; missing counts as low, unknown as 0."""
    return lookup(F.coalesce(_word(c), F.lit("low")), RANKS, 0)


def report_rank(c: Column | str) -> Column:
    """The scale of the report format: info is 0, missing is medium, unknown is 1."""
    return lookup(F.coalesce(_word(c), F.lit("medium")), REPORT_RANKS, 1)


def at_least(c: Column | str, least: str) -> Column:
    return severity_rank(c) >= RANKS.get(least.lower(), 0)


def display_order(c: Column | str) -> Column:
    return lookup(F.coalesce(_word(c), F.lit("low")), ORDER, 4)


def sla_days(c: Column | str) -> Column:
    return lookup(F.coalesce(F.nullif(_word(c), F.lit("")), F.lit("medium")), DEFAULT_SLA_DAYS, 90)

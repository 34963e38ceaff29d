"""Component lists in the CycloneDX format, read back with contradictions left out and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestrata.operators.nested import listed, member, text


def components(reports: DataFrame) -> DataFrame:
    """(path, ref, name, version, purl, problem): one row per component; a purl that contradicts name or version is its problem."""
    v = F.try_parse_json("body")
    df = reports.select("path", F.explode(listed(member(v, "components"))).alias("c"))
    c = F.col("c")
    out = df.select("path", *[text(member(c, n)).alias(a) for n, a in (("bom-ref", "ref"), ("group", "grp"), ("name", "name"), ("version", "version"), ("purl", "purl"))])
    full = F.concat_ws("/", F.nullif("grp", F.lit("")), "name")
    said = F.try_url_decode(F.regexp_extract("purl", r"^pkg:[^/]+/([^@?#]+)", 1))
    selected = F.try_url_decode(F.nullif(F.regexp_extract("purl", r"@([^?#]+)", 1), F.lit("")))
    problem = (
        F.when(F.col("name").isNull(), "no-name").when(F.col("purl").isNull(), "no-purl").when(said != full, "name-contradicts-purl")
        .when(~selected.eqNullSafe(F.col("version")), "version-contradicts-purl")
    )
    return out.select("path", "ref", full.alias("name"), "version", "purl", problem.alias("problem"))


def imported(reports: DataFrame) -> DataFrame:
    """(purl, name, version, seen): components without a problem, once each, with how often they were listed."""
    good = components(reports).where("problem is null")
    return good.groupBy("purl", "name", "version").agg(F.count(F.lit(1)).alias("seen"))

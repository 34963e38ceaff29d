"""Operators over the dependency inventory: occurrences, relationships, licences and their integrity.

Joins are equalities on ids or names; a name that a third of all packages use is only ever met by
aggregated or distinct rows. Searches for a unique match, a nearest ancestor or a reachable root
are relational: counts per selector, exploded ancestors, the list-ranked hierarchy.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import BooleanType

from lodestrata.functions.markers import disjoint
from lodestrata.functions.text import key
from lodestrata.operators.joins import lookup
from lodestrata.operators.stored import positions
from lodestrata.storage import Workspace


def occurrences_of(raw: DataFrame) -> DataFrame:
    """One row per occurrence id: the latest record; ids trimmed and in lower case; rows without id are left out."""
    names = [c for c in raw.columns if c not in ("id", "recorded_at")]
    latest = F.max(F.struct("recorded_at", *names))
    return raw.select(key("id").alias("id"), "recorded_at", *names).where("id is not null").groupBy("id").agg(latest.alias("_v")).select("id", "_v.*")


def relationships_of(raw: DataFrame) -> DataFrame:
    """Distinct edges with both ends: of each (parent, child) the latest record."""
    latest = F.max(F.struct("recorded_at", "evidence_status", "activation", "scopes", F.col("source.path").alias("path"), F.col("source.parser").alias("parser")))
    ends = raw.select(key("parent_id").alias("parent_id"), key("child_id").alias("child_id"), "recorded_at", "evidence_status", "activation", "scopes", "source")
    return ends.where("parent_id is not null and child_id is not null").groupBy("parent_id", "child_id").agg(latest.alias("_v")).select("parent_id", "child_id", "_v.*")


def unique_match(selectors: DataFrame, candidates: DataFrame, keys: Sequence[str], residual: Column, selector: str, candidate: str) -> DataFrame:
    """(selector, candidate, matches): resolved exactly if one candidate fits, else null.

    Candidates are counted per selector in one aggregate; a group holds a count and one id, never a list.
    """
    met = selectors.join(candidates, list(keys), "left")
    fits = F.coalesce(residual, F.lit(False)) & F.col(candidate).isNotNull()
    out = met.groupBy(selector).agg(F.count_if(fits).alias("matches"), F.min(F.when(fits, F.col(candidate))).alias("_one"))
    return out.select(selector, F.when(F.col("matches") == 1, F.col("_one")).alias(candidate), "matches")


def unique_by_key(selectors: DataFrame, candidates: DataFrame, keys: Sequence[str], selector: str, candidate: str) -> DataFrame:
    """As `unique_match` where the keys alone decide: candidates are counted per key before one join, so no key makes pairs.

    A key that most selectors share is treated apart; null keys match nothing.
    """
    work = Workspace(selectors.sparkSession, "unique")
    counts = candidates.groupBy(*keys).agg(F.count(candidate).alias("matches"), F.min(candidate).alias("_one"))
    asked = work.cut(selectors.select(selector, *keys), "asked")
    met = lookup(asked, work.cut(counts, "counts"), list(keys), written=True).select(selector, "matches", "_one")
    out = asked.select(selector).join(met, selector, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return out.select(selector, F.when(F.col("matches") == 1, F.col("_one")).alias(candidate), "matches")


def nearest_ancestor(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, name, entry): the lock entry that a package directory search finds, from the nearest directory up.

    `requests`: (path, name), `entries`: (entry). Every directory on the way up is a candidate key, so
    the search is an equality join and the deepest hit a combined maximum. A request at depth n
    makes n rows. A present entry that is refused is still the hit, and blocks those above.
    """
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("at")))
    at = requests.select("path", "name", F.inline(above)).where(~F.col("at").rlike("(^|/)node_modules$"))
    tried = at.withColumn("entry", F.concat(F.when(F.col("at") == "", "").otherwise(F.concat("at", F.lit("/"))), F.lit("node_modules/"), "name"))
    hits = tried.join(entries.select("entry").distinct(), "entry")
    best = hits.groupBy("path", "name").agg(F.max_by("entry", "depth").alias("entry"))
    return requests.select("path", "name").distinct().join(best, ["path", "name"], "left")


def reached(edges: DataFrame, roots: DataFrame, work: Workspace) -> DataFrame:
    """(id): the roots and every node that a walk along the edges comes to from one of them.

    `edges` is written, `roots`: (id) are parents that nothing names, all or some of them. A node with one parent is
    reached exactly if the parent is, so it first follows its parents, two hops, four, eight and so on, to
    the next root or node of several parents; what never settles hangs on a loop that no root leads to.
    What is left is walked level by level: one job a node of several parents on the way, not one a link.
    All parents count. Lookups are by unique id; no group holds a list.
    """
    named = edges.groupBy(F.col("child_id").alias("id")).agg(F.min("parent_id").alias("_one"), F.max("parent_id").alias("_last"))
    several = F.col("_one") != F.col("_last")
    first = named.select("id", F.when(several, F.col("id")).otherwise(F.col("_one")).alias("at"), several.alias("settled"))
    hops = work.cut(first.unionAll(roots.select("id", F.col("id").alias("at"), F.lit(True).alias("settled"))), "hops")
    before, left = None, hops.where("not settled").count()
    while left and left != before:
        ahead = hops.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("settled").alias("_settled"))
        moved = hops.where("not settled").join(ahead, "at").select("id", F.col("_at").alias("at"), F.col("_settled").alias("settled"))
        done, hops = hops, work.cut(hops.where("settled").unionAll(moved), "hops")
        work.drop(done)
        before, left = left, hops.where("not settled").count()
    hops = hops.where("settled")
    meets = edges.join(named.where(several).select(F.col("id").alias("child_id")), "child_id")
    links = meets.join(hops.select(F.col("id").alias("parent_id"), "at"), "parent_id").where("at != child_id").select("at", "child_id").distinct()
    links = work.cut(links, "links")
    level, seen = 0, work.cut(roots.select("id", F.lit(0).alias("level")), "seen")
    while True:
        front = seen.where(F.col("level") == level).select(F.col("id").alias("at"))
        new = links.join(front, "at").select(F.col("child_id").alias("id")).distinct().join(seen, "id", "left_anti")
        level += 1
        done, seen = seen, work.cut(seen.unionAll(new.select("id", F.lit(level).alias("level"))), "seen")
        work.drop(done)
        if seen.where(F.col("level") == level).isEmpty():
            return hops.join(seen.select(F.col("id").alias("at")), "at", "left_semi").select("id")


def reachability(occurrences: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, directness): direct if a root names it, transitive if it is reached over others, else unknown.

    `edges`: (parent_id, child_id). A parent that nothing names is a root. What only loops lead to, loops
    themselves and ids that nothing names are unknown.
    """
    work = Workspace(occurrences.sparkSession, "reachability")
    edges = work.cut(edges.select("parent_id", "child_id"), "edges")
    roots = work.cut(edges.select(F.col("parent_id").alias("id")).distinct().join(edges.select(F.col("child_id").alias("id")), "id", "left_anti"), "roots")
    inner = reached(edges, roots, work).join(roots, "id", "left_anti").select("id", F.lit("transitive").alias("_how"))
    direct = edges.join(roots.select(F.col("id").alias("parent_id")), "parent_id").select(F.col("child_id").alias("id"), F.lit("direct").alias("_how"))
    nearest = inner.unionAll(direct).groupBy("id").agg(F.min("_how").alias("_how"))
    return occurrences.select("id").join(nearest, "id", "left").select("id", F.coalesce("_how", F.lit("unknown")).alias("directness"))


def include_contexts(files: DataFrame, edges: DataFrame, most_depth: int = 64) -> tuple[DataFrame, DataFrame]:
    """((origin, path, role, hops), cut) of every file that each file of `files` (path) includes over any way.

    `edges`: (path, target, kind). All parents count: a file that several include has a row for each origin and
    role. A role is constraint once any include on the way is one. Ways don't turn back: a target that is on its own
    way is a circle and left out. Walked level by level, a job each; ways longer than `most_depth` includes are not
    followed, and the second result has the (origin, path, target) where that happened, so nothing ends unseen.
    """
    work = Workspace(files.sparkSession, "includes")
    links = work.cut(edges.select("path", "target", "kind").dropna(subset=["path", "target"]).distinct(), "links")
    role = F.when(F.col("path").rlike(r"(^|/)constraints([-_.][^/]*)?\.(txt|in|pip)$"), "constraint").otherwise("requirement")
    start = files.select(F.col("path").alias("origin"), "path", role.alias("role"), F.lit(0).alias("hops"), F.array("path").alias("way")).dropDuplicates(["path"])
    level, front = 0, work.cut(start, "level")
    seen = front
    while True:
        turned = F.when((F.col("role") == "constraint") | (F.col("kind") == "constraint"), "constraint").otherwise("requirement")
        steps = front.join(links, "path").where(~F.array_contains("way", F.col("target")))
        if level == most_depth or front.isEmpty():
            return seen.select("origin", "path", "role", "hops"), steps.select("origin", "path", "target").distinct()
        level += 1
        steps = steps.select("origin", F.col("target").alias("path"), turned.alias("role"), F.lit(level).alias("hops"), F.concat("way", F.array("target")).alias("way"))
        least = steps.groupBy("origin", "path", "role", "hops").agg(F.min("way").alias("way"))
        front = work.cut(least.join(seen.select("origin", "path", "role"), ["origin", "path", "role"], "left_anti"), "level")
        seen = seen.unionByName(front)


def ranked(occurrences: DataFrame, by: str) -> DataFrame:
    """name_version_rank: 0-based position by (name, version missing, version, id) within each snapshot."""
    order = [F.coalesce("name", F.lit("")), F.col("selected_version").isNull(), F.coalesce("selected_version", F.lit("")), F.col("id")]
    return positions(occurrences, [by], order, ["id"], "name_version_rank")


def facets(occurrences: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(id, facet, value): distinct values of array columns."""


    def entries(c: str) -> Column:
        values = F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>")))
        return F.transform(values, lambda x: F.struct(F.lit(c).alias("facet"), x.alias("value")))

    each = [entries(c) for c in columns]
    return occurrences.select("id", F.inline(F.concat(*each))).where("value is not null").distinct()


def license_states(occurrences: DataFrame, observations: DataFrame) -> DataFrame:
    """(id, state, expression): stated, conflicting, unparsed or unstated. `observations`: (occurrence_id, expression)."""
    seen = observations.groupBy("occurrence_id").agg(
        F.bool_or(F.col("expression").isNull()).alias("_open"), F.min("expression").alias("_low"), F.max("expression").alias("_high")
    )
    state = F.when(F.col("_open").isNull(), "unstated").when(F.col("_open"), "unparsed").when(F.col("_low") != F.col("_high"), "conflicting").otherwise("stated")
    out = occurrences.select("id").join(seen, F.col("id") == F.col("occurrence_id"), "left").withColumn("state", state)
    return out.select("id", "state", F.when(F.col("state") == "stated", F.col("_low")).alias("expression"))


def license_gaps(occurrences: DataFrame, observations: DataFrame) -> DataFrame:
    """Occurrences that nothing states a licence of."""
    return occurrences.select("id").join(observations.select(F.col("occurrence_id").alias("id")), "id", "left_anti")


def exportable(occurrences: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components, dependencies) of an export: packages with purl and version; evidenced active edges between them.

    Dependencies come as (ref, depends_on), ready to be grouped; both ends are checked by semi joins.
    """
    parts = occurrences.where("purl is not null and purl <> '' and selected_version is not null").select("id", "name", F.col("selected_version").alias("version"), "purl", "ecosystem")
    good = edges.where("evidence_status = 'evidenced' and activation = 'active'").select("parent_id", "child_id")
    ids = parts.select("id")
    good = good.join(ids.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi").join(ids.withColumnRenamed("id", "child_id"), "child_id", "left_semi")
    return parts, good.select(F.col("parent_id").alias("ref"), F.col("child_id").alias("depends_on"))


def cyclonedx(parts: DataFrame, dependencies: DataFrame) -> DataFrame:
    """One JSON text per component with its sorted dependencies; null members are left out."""
    below = dependencies.groupBy("ref").agg(F.sort_array(F.collect_set("depends_on")).alias("dependsOn"))
    out = parts.join(below, F.col("id") == F.col("ref"), "left")
    body = F.struct(F.col("id").alias("bom-ref"), F.lit("library").alias("type"), "name", "version", "purl", "dependsOn")
    return out.select("id", F.to_json(body).alias("component"))


def broken(occurrences: DataFrame, edges: DataFrame, observations: DataFrame) -> DataFrame:
    """(rule, n): how many rows break each integrity rule; rules without a violation are absent.

    One anti join or aggregate per rule, united; nothing is collected.
    """
    ids = occurrences.select(key("id").alias("id")).where("id is not null").distinct()
    missing = lambda rows, c: rows.select(key(c).alias("id")).where("id is not null").join(ids, "id", "left_anti")
    rules = {
        "occurrence-id-missing": occurrences.where(key("id").isNull()),
        "occurrence-id-repeated": occurrences.select(key("id").alias("id")).where("id is not null").groupBy("id").count().where("count > 1"),
        "edge-parent-unknown": missing(edges, "parent_id"),
        "edge-child-unknown": missing(edges, "child_id"),
        "edge-end-missing": edges.where(key("parent_id").isNull() | key("child_id").isNull()),
        "edge-to-itself": edges.where(key("parent_id") == key("child_id")),
        "license-occurrence-unknown": missing(observations, "occurrence_id"),
        "installed-without-version": occurrences.where("evidence_kind = 'installed' and selected_version is null"),
    }
    out = None
    for name, rows in rules.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out.where("n > 0")


def summary(occurrences: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts: packages, packages with a version, edges, evidenced edges."""
    a = occurrences.agg(F.count(F.lit(1)).alias("package_occurrences"), F.count("selected_version").alias("selected_occurrences"))
    b = edges.agg(F.count(F.lit(1)).alias("canonical_relationships"), F.count_if(F.col("evidence_status") == "evidenced").alias("evidenced_relationships"))
    return a.select("*", F.lit(1).alias("_k")).join(b.select("*", F.lit(1).alias("_k")), "_k").drop("_k")


def coverage(inputs: DataFrame, by: str) -> DataFrame:
    """(by, fidelity) of inputs (by, disposition): complete if all parsed, failed if all failed, unknown without any, else partial."""
    good, bad = F.bool_and(F.col("disposition") == "parsed"), F.bool_and(F.col("disposition") == "failed")
    return inputs.groupBy(by).agg(F.when(good, "complete").when(bad, "failed").otherwise("partial").alias("fidelity"))


def unique_range(edges: DataFrame) -> DataFrame:
    """(child, declared_range): the range that is declared of a package, kept only where all agree."""
    return edges.groupBy("child").agg(F.min("declared_range").alias("_a"), F.max("declared_range").alias("_b")).where("_a = _b").select("child", F.col("_a").alias("declared_range"))


def overlaps(rows: DataFrame, name: str, variant: str, low: str, high: str) -> DataFrame:
    """(name, first, second): variants of one name, next to each other in order, whose spans overlap.

    Sorted neighbours against the furthest end so far find every group that overlaps, without pairs.
    """
    w = W.partitionBy(name).orderBy(low, variant)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    out = rows.withColumns({"_end": F.max(F.struct(high, variant)).over(before)})
    return out.where(F.col(low) <= F.col(f"_end.{high}")).select(name, F.col(f"_end.{variant}").alias("first"), F.col(variant).alias("second"))


def variant_overlaps(packages: DataFrame) -> DataFrame:
    """(path, name, first, second) of the packages of one lock that may hold at once: same name, scopes and extras, markers not disjoint.

    `packages`: (path, name, scopes, extras, marker, locator). Packages are first reduced to distinct markers per key, and only
    those are met: what shares a marker is named by its first and last locator, so copies make no pairs.
    """

    @F.pandas_udf(BooleanType())
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([disjoint(x, y) for x, y in zip(a, b)], dtype=object)

    key = ["path", "name", "scopes", "extras"]
    plain = packages.select("path", "name", *[F.coalesce(F.array_sort(c), F.array().cast("array<string>")).alias(c) for c in ("scopes", "extras")], F.coalesce("marker", F.lit("")).alias("marker"), "locator")
    distinct = plain.groupBy(*key, "marker").agg(F.min("locator").alias("first"), F.max("locator").alias("last"))
    distinct = Workspace(packages.sparkSession, "variants").cut(distinct, "variants")
    within = distinct.where(F.col("first") < F.col("last")).select("path", "name", "first", F.col("last").alias("second"))
    other = distinct.select(*key, F.col("marker").alias("_marker"), F.col("first").alias("second"))
    met = distinct.select(*key, "marker", "first").join(other, key).where((F.col("marker") < F.col("_marker")) & ~apart(F.nullif("marker", F.lit("")), F.nullif("_marker", F.lit(""))))
    return met.select("path", "name", F.least("first", "second").alias("first"), F.greatest("first", "second").alias("second")).unionByName(within)


def row_digest(rows: DataFrame, keys: Sequence[str], values: Sequence[str], by: str) -> DataFrame:
    """(by, n, digest) of keyed rows: independent of their order and of how they are spread.

    Rows hash to SHA-256; eight slices of eight hexadecimal digits are summed per group as exact decimals, so
    partial sums combine on the map side, and the sums are hashed. Two-phase and without a sort.
    """
    text = F.concat_ws("\x1f", *[x for c in (*keys, *values) for x in (F.col(c).isNull().cast("string"), F.coalesce(F.col(c).cast("string"), F.lit("")))])
    h = F.sha2(text, 256)
    slices = [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    sums = [F.sum(x).alias(f"_s{i}") for i, x in enumerate(slices)]
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *sums)
    return out.select(by, "n", F.sha2(F.concat_ws(":", "n", *[f"_s{i}" for i in range(8)]), 256).alias("digest"))


def bound_matches(matches: DataFrame, occurrences: DataFrame, checked: Sequence[str]) -> DataFrame:
    """(ordinal, occurrence_id, problem): vulnerability matches bound to occurrences, misses and contradictions named.

    Nothing is dropped: a match whose id is unknown, or of which a checked column differs, carries its problem.
    """
    known = occurrences.select(F.col("id").alias("occurrence_id"), *[F.col(c).alias(f"_{c}") for c in checked], F.lit(True).alias("_known"))
    out = matches.join(known, "occurrence_id", "left")
    differs = F.lit(False)
    for c in checked:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out.select("ordinal", "occurrence_id", F.when(F.col("_known").isNull(), "unknown-occurrence").when(differs, "contradicts-occurrence").alias("problem"))


def constraint_links(requirements: DataFrame, constraints: DataFrame) -> DataFrame:
    """(requirement, constraint): same name; same marker, or none; or not provably disjoint markers."""

    @F.pandas_udf(BooleanType())
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([disjoint(x, y) for x, y in zip(a, b)], dtype=object)

    r = requirements.select(F.col("id").alias("requirement"), "name", F.col("marker").alias("_a"))
    c = constraints.select(F.col("id").alias("constraint"), "name", F.col("marker").alias("_b"))
    return r.join(c, "name").where(~apart("_a", "_b")).select("requirement", "constraint")

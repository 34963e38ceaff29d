"""Rows of package files composed into occurrences, dependency selectors, relationships, coverage and losses.

`read_packages` says what each file holds; here its packages get identities and its dependency entries are
resolved inside the file they stand in. All formats share one plan. A package is known under keys, a
selector looks for keys, in order of depth where a format searches upwards:

* npm: a package under its entry; a selector looks in every node_modules from its parent up, the nearest
  entry counts even if it is refused;
* pnpm: name@version; yarn: each of its descriptors;
* cargo: name, name and version, or these and the source, as much as the selector states; refused
  packages block;
* nuget: the name inside its target framework;
* Python locks: the name; several packages of a name are told apart by the range or version.

Keys and selectors meet as distinct values: ranges are checked once per (file, key, range, version), and a
name that a file lists n times and asks for m times never makes n times m rows.

Which packages are direct is said by the file where it does (npm's own entry, pnpm's importers, nuget's type);
what a walk from these reaches over resolved selectors is transitive, the rest unknown. pnpm's contexts of several importers
are one here. Defined results: a file that is not parsed has coverage and nothing else; a package whose name or
version its ecosystem does not admit is no occurrence; an ecosystem's null range asks for nothing; repeated rows collapse.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lodestrata.functions import ids, versions
from lodestrata.operators.hierarchy import node_key
from lodestrata.operators.inventory import reached
from lodestrata.storage import Workspace

# Fixed values: (reason of a selector without a target, of one with several, of a contradicted range, of a range that can't be read, of a resolved one).
REASONS = {
    "npm-lock": ("npm-source-endpoint-not-admitted", "npm-source-endpoint-not-admitted", "npm-selector-version-mismatch", "unsupported-npm-dependency-selector", "unique-source-endpoint"),
    "pnpm-lock": ("pnpm-source-endpoint-not-admitted", "pnpm-source-endpoint-not-admitted", "unresolved-pnpm-importer-selection", "unresolved-pnpm-importer-selection", "unique-source-endpoint"),
    "yarn-lock": ("yarn-source-endpoint-not-admitted", "ambiguous-yarn-source-descriptor", "yarn-selector-version-mismatch", "unsupported-yarn-dependency-selector", "unique-source-endpoint"),
    "cargo-lock": ("cargo-source-endpoint-not-admitted", "ambiguous-cargo-lock-selector", "", "", "unique-source-endpoint"),
    "nuget-lock": ("missing-nuget-lock-endpoint", "missing-nuget-lock-endpoint", "contradictory-nuget-dependency-range", "unassessed-nuget-dependency-range", "source-nuget-lock-endpoint"),
    "python": ("missing-lock-dependency", "ambiguous-lock-dependency", "missing-lock-dependency", "missing-lock-dependency", "unambiguous-lock-selection"),
}
PEER = {"npm-lock": "npm-peer-context-unassessed", "yarn-lock": "yarn-peer-context-unassessed"}
# What a format's lock does not assess: (dimension, reason) of an entry that stands for a loss.
LOSSES = {
    "composer-lock": {"": ("graph", "unassessed-composer-dependency-graph")},
    "bundler-lock": {"": ("graph", "unassessed-bundler-dependency-graph")},
    "go-mod": {
        "replace": ("version", "unassessed-replace-directive"), "exclude": ("version", "unassessed-exclude-directive"), "retract": ("version", "unassessed-retract-directive"),
        "tool": ("scope", "unassessed-tool-directive"), "godebug": ("environment", "unassessed-godebug-directive"), "ignore": ("graph", "unassessed-ignore-directive"),
    },
}


@dataclass(frozen=True)
class Composed:
    occurrences: DataFrame
    selectors: DataFrame
    relationships: DataFrame
    declarations: DataFrame
    coverage: DataFrame
    losses: DataFrame


def _format() -> Column:
    """The format, Python's locks as one."""
    return F.when(F.col("format").startswith("python-"), "python").otherwise(F.col("format"))


def _joined(*parts: Column) -> Column:
    return F.concat_ws("\x1f", *parts)


def _above(parent: Column, name: Column) -> Column:
    """(depth, key) of the entries that a package at the entry `parent` may mean by `name`."""
    parts = F.filter(F.split(parent, "/"), lambda x: x != "")
    tried = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("at")))
    tried = F.filter(tried, lambda x: ~x.at.rlike("(^|/)node_modules$"))
    return F.transform(tried, lambda x: F.struct(x.depth.alias("depth"), F.concat(F.when(x.at == "", "").otherwise(F.concat(x.at, F.lit("/"))), F.lit("node_modules/"), name).alias("key")))


def _keys(f: Column) -> Column:
    """Under which keys a package is known."""
    c = F.col
    return (
        F.when(f == "npm-lock", F.array("locator"))
        .when(f == "pnpm-lock", F.array(F.concat_ws("@", "name", "version")))
        .when(f == "yarn-lock", c("extras"))
        .when(f == "cargo-lock", F.array(c("name"), _joined(c("name"), c("version")), _joined(c("name"), c("version"), F.coalesce("registry_sha256", F.lit("")))))
        .when(f == "nuget-lock", F.array(_joined(c("scopes")[0], c("name"))))
        .when(f == "python", F.array("name"))
        .otherwise(F.array().cast("array<string>"))
    )


def _sought(f: Column) -> Column:
    """(depth, key) that a selector looks for; the greatest depth that is met counts."""
    c = F.col
    one = lambda *keys: F.array(*[F.struct(F.lit(len(keys) - i).alias("depth"), k.alias("key")) for i, k in enumerate(keys)])
    exact = F.when(c("version").isNull(), c("name")).when(c("registry_sha256").isNull(), _joined(c("name"), c("version"))).otherwise(_joined(c("name"), c("version"), c("registry_sha256")))
    return (
        F.when(f == "npm-lock", _above(c("parent"), c("name")))
        .when(f == "pnpm-lock", one(F.concat_ws("@", "name", "version")))
        .when(f == "yarn-lock", one(F.concat_ws("@", "name", "range"), F.concat(c("name"), F.lit("@npm:"), c("range"))))
        .when(f == "cargo-lock", one(exact))
        .when(f == "nuget-lock", one(_joined(c("scopes")[0], c("name"))))
        .otherwise(one(c("name")))
    )


def _parent(f: Column) -> Column:
    """The locator of the package that a dependency entry stands in; of yarn, its descriptor; of an importer or the lock's own entry, null."""
    c = F.col
    return (
        F.when(f == "npm-lock", F.nullif("parent", F.lit("")))
        .when(f == "yarn-lock", c("parent"))
        .when((f == "pnpm-lock") & c("locator").startswith("/importers/"), F.lit(None))
        .otherwise(F.regexp_extract("locator", "^(.+)/dependencies/", 1))
    )


def _fits(f: Column, version: Column, wanted: Column, exact: Column) -> Column:
    """Whether a version is admitted; null if that can't be told."""
    npm, pep, nuget = versions.npm_admits(version, wanted), versions.pep440_admits(version, wanted), versions.nuget_satisfies(version, wanted)
    asks = wanted.isNotNull() & (F.trim(wanted) != "")
    return (
        F.when(f == "cargo-lock", F.lit(True))
        .when(f == "nuget-lock", nuget)
        .when(f == "python", (exact.isNull() | (exact == version)) & F.when(asks & (wanted != "*"), pep).otherwise(True))
        .otherwise(F.when(asks, npm).otherwise(True))
    )


def composed(rows: DataFrame) -> Composed:
    """The tables of all files of `rows`, which has the columns of `read_packages`."""
    work, c = Workspace(rows.sparkSession, "composition"), F.col
    # a file goes by the digest of its path, which may be long, wherever rows are shuffled
    rows = work.cut(rows.withColumn("f", _format()).withColumn("file", node_key("path")), "rows")
    parsed = rows.where("status = 'parsed'")
    made = parsed.where("kind = 'package'").dropDuplicates(["file", "locator", "scopes"])
    made = made.withColumn("purl", ids.purl(c("ecosystem"), c("name"), c("version")))
    refused = c("purl").isNull() | c("version").isNull() | F.array_contains("scopes", "local")
    packages = work.cut(made.withColumn("admitted", ~refused), "packages")

    entries = parsed.where("kind = 'edge' and name is not null").withColumn("eid", F.monotonically_increasing_id())
    entries = work.cut(entries.select("eid", "file", "path", "f", "ecosystem", "name", "version", "range", "scopes", "marker", "parent", "registry_sha256", "locator"), "entries")
    known = packages.select("file", "f", F.explode(_keys(c("f"))).alias("key"), "version", "locator", "admitted")
    known = work.cut(known.groupBy("file", "f", "key", "version").agg(F.count_distinct("locator").alias("n"), F.min(F.struct("locator", "admitted")).alias("one")), "known")
    sought = work.cut(entries.select("eid", "file", "f", F.inline(_sought(c("f"))), c("range").alias("wanted"), F.when(c("f") == "python", c("version")).alias("exact")), "sought")
    asked = sought.select("file", "f", "key", "wanted", "exact").distinct().join(known, ["file", "f", "key"])
    checked = work.cut(asked.withColumn("fits", _fits(c("f"), c("version"), c("wanted"), c("exact"))), "checked")
    # only Python's locks choose among several packages of a key by what fits
    chosen = (c("f") != "python") | F.coalesce("fits", F.lit(False))
    answers = checked.groupBy("file", "f", "key", "wanted", "exact").agg(
        F.sum(F.when(chosen, c("n")).otherwise(0)).alias("n"), F.min(F.when(chosen, F.struct("one", "version"))).alias("target"),
        F.bool_and(F.coalesce("fits", F.lit(False))).alias("all_fit"), F.bool_or(c("fits").isNull()).alias("unread"),
    )
    same = lambda n: sought[n].eqNullSafe(answers[n])
    hits = sought.join(answers, (sought.file == answers.file) & (sought.key == answers.key) & same("wanted") & same("exact"))
    best = hits.groupBy("eid").agg(F.max(F.struct(sought.depth, "n", "target", "all_fit", "unread")).alias("b")).select("eid", "b.*")
    out = entries.join(best, "eid", "left").withColumns({"parent_locator": _parent(c("f")), "n": F.coalesce("n", F.lit(0))})
    reason = lambda i: F.create_map(*[x for k, v in REASONS.items() for x in (F.lit(k), F.lit(v[i]))])[c("f")]
    peer = F.array_contains("scopes", "peerDependencies")
    peers = F.create_map(*[F.lit(x) for k, v in PEER.items() for x in (k, v)])[c("f")]
    said = (
        F.when(peer, peers)
        .when(c("n") == 0, reason(0))
        .when(c("n") > 1, reason(1))
        .when(~c("target.one.admitted"), reason(0))
        .when((c("f") != "python") & c("unread"), reason(3))
        .when((c("f") != "python") & ~c("all_fit"), reason(2))
        .otherwise(reason(4))
    )
    out = out.withColumn("reason", said)
    out = out.withColumn("child_locator", F.when(c("reason") == reason(4), c("target.one.locator")))
    # yarn names the parent by a descriptor
    owner = known.where("f = 'yarn-lock'").select("file", c("key").alias("parent_locator"), c("one.locator").alias("owner"))
    out = out.join(owner.dropDuplicates(["file", "parent_locator"]), ["file", "parent_locator"], "left")
    selectors = out.select(
        "file", "path", "ecosystem", F.coalesce("owner", "parent_locator").alias("parent_locator"), "child_locator", "name", c("range").alias("declared_range"),
        F.when(c("child_locator").isNotNull(), c("target.version")).alias("exact_version"), "scopes", "marker",
        F.when(c("child_locator").isNotNull(), "resolved").otherwise("unresolved").alias("disposition"), "reason", "locator",
    )
    # what a refused package asks for is nobody's
    heads = packages.where("admitted").select("file", c("locator").alias("parent_locator"))
    inner = selectors.where("parent_locator is not null").join(heads, ["file", "parent_locator"], "left_semi").select(selectors.columns)
    selectors = work.cut(selectors.where("parent_locator is null").unionByName(inner), "selectors")
    for spent in (entries, known, sought, checked):
        work.drop(spent)

    node = lambda locator: F.concat_ws("\x1f", F.hex("file"), locator)
    resolved = selectors.where("disposition = 'resolved'")
    edges = work.cut(resolved.where("parent_locator is not null").select(node("parent_locator").alias("parent_id"), node("child_locator").alias("child_id")).distinct(), "edges")
    direct = work.cut(resolved.where("parent_locator is null").select(node("child_locator").alias("id")).distinct(), "direct")
    walked = reached(edges.unionByName(direct.select(F.lit("").alias("parent_id"), c("id").alias("child_id"))), rows.sparkSession.createDataFrame([("",)], "id string"), work)
    how = walked.where("id <> ''").select("id", F.lit("transitive").alias("how")).unionByName(direct.withColumn("how", F.lit("direct"))).groupBy("id").agg(F.min("how").alias("how"))
    nuget = F.when(c("f") == "nuget-lock", F.when(c("marker") == "Direct", "direct").otherwise("transitive"))
    ranges = selectors.where("parent_locator is null and child_locator is not null").groupBy("file", c("child_locator").alias("locator"))
    ranges = ranges.agg(F.min("declared_range").alias("_low"), F.max("declared_range").alias("_high")).where("_low = _high").select("file", "locator", c("_low").alias("_asked"))
    placed = packages.where("admitted").withColumn("id", node("locator")).join(how, "id", "left").join(ranges, ["file", "locator"], "left")
    occurrences = placed.select(
        "path", "locator", "ecosystem", "name", c("version").alias("selected_version"), F.coalesce("range", "_asked").alias("declared_range"), "purl",
        F.when(c("f") == "python-installed-metadata", "installed").otherwise("locked").alias("evidence_kind"), F.coalesce(nuget, "how", F.lit("unknown")).alias("directness"), "scopes", "hashes", "registry_sha256", "license",
    )
    required = parsed.where("kind = 'declaration' and format in ('npm-manifest', 'go-mod')").withColumn("purl", ids.purl(c("ecosystem"), c("name"), c("version"))).where("name is not null")
    declared = required.select(
        "path", "locator", "ecosystem", "name", c("version").alias("selected_version"), c("range").alias("declared_range"), F.coalesce("purl", ids.purl(c("ecosystem"), c("name"), F.lit(None).cast("string"))).alias("purl"),
        F.lit("declared").alias("evidence_kind"), F.when(c("format") == "npm-manifest", "direct").otherwise("unknown").alias("directness"), "scopes", "hashes", "registry_sha256", "license",
    )
    declarations = parsed.where("kind = 'declaration'").select("path", "locator", "ecosystem", "name", c("range").alias("declared_range"), c("version").alias("exact_version"), "scopes", "extras", "marker")

    unresolved = selectors.where("disposition = 'unresolved'").groupBy("path").agg(F.count(F.lit(1)).alias("unresolved"))
    inputs = rows.where("kind = 'input'").select("path", "format", c("status").alias("disposition"), "reason").dropDuplicates(["path"])
    fidelity = F.when(c("disposition") == "parsed", F.when(F.coalesce("unresolved", F.lit(0)) == 0, "complete").otherwise("partial")).when(c("disposition") == "failed", "failed").otherwise("unknown")
    coverage = inputs.join(unresolved, "path", "left").select("path", "format", "disposition", "reason", F.coalesce("unresolved", F.lit(0)).alias("unresolved"), fidelity.alias("fidelity"))
    table = F.create_map(*[x for f, by in LOSSES.items() for n, (d, r) in by.items() for x in (F.lit(f"{f}/{n}"), F.struct(F.lit(d).alias("dimension"), F.lit(r).alias("reason")))])
    of = F.when(c("format") == "go-mod", F.concat_ws("/", "format", "name")).otherwise(F.concat("format", F.lit("/")))
    losses = parsed.where("kind = 'loss'").select("path", "locator", table[of].alias("l")).select("path", "locator", "l.dimension", "l.reason")
    indirect = parsed.where("format = 'go-mod' and kind = 'declaration' and array_contains(scopes, 'indirect')")
    losses = losses.unionByName(indirect.select("path", "locator", F.lit("graph").alias("dimension"), F.lit("unassessed-go-indirect-annotation").alias("reason")))
    relationships = resolved.where("parent_locator is not null").select("path", "parent_locator", "child_locator", "scopes", F.lit("evidenced").alias("evidence_status"))
    return Composed(occurrences.unionByName(declared), selectors.drop("file"), relationships, declarations, coverage, losses)


# What may become of an input.
DISPOSITIONS = ["parsed", "unresolved", "unsupported", "failed", "bounded-omission", "ignored", "discovered", "unrecognized"]


def summary(c: Composed) -> DataFrame:
    """(name, n): the nine counts of an inventory and how many inputs came to each disposition, zeros included."""
    spark = c.coverage.sparkSession
    inputs = c.coverage.agg(
        F.count(F.lit(1)).alias("discovered_inputs"), F.count("format").alias("recognized_inputs"),
        *[F.count_if(F.col("disposition") == d).alias(f"input_dispositions.{d}") for d in DISPOSITIONS],
    )
    made = c.occurrences.agg(F.count(F.lit(1)).alias("package_occurrences"), F.count("selected_version").alias("selected_occurrences"))
    edges = c.relationships.agg(F.count(F.lit(1)).alias("canonical_relationships"), F.count_if(F.col("evidence_status") == "evidenced").alias("evidenced_relationships"))
    more = [c.declarations.agg(F.count(F.lit(1)).alias("declarations")), c.losses.agg(F.count(F.lit(1)).alias("canonical_projection_losses"))]
    out = spark.createDataFrame([], "name string, n long")
    for one in [inputs, made, edges, *more]:
        pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("n")) for n in one.columns])
        out = out.unionByName(one.select(F.inline(pairs)))
    return out

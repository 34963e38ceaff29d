"""Registered queries over the inventory, each with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import ids, licenses, versions
from lodestrata.functions.text import key
from lodestrata.operators import composition, inventory as op, resolution, stored
from lodestrata.sources import config, packages
from lodestrata.operators.joins import lookup
from lodestrata.storage import Workspace, table

POLICY = licenses.LicensePolicy(["MIT", "BSD-*", "Apache-2.0"], ["GPL-*", "AGPL-*"])


def _occurrences(spark, d):
    return op.occurrences_of(table(spark, d, "occurrences"))


def _edges(spark, d):
    return op.relationships_of(table(spark, d, "relationships"))


def _observations(spark, d):
    o = table(spark, d, "license_observations")
    parsed = F.when(F.col("parse") != "unparsed", F.nullif(F.trim("expression"), F.lit("")))
    return o.select(key("occurrence_id").alias("occurrence_id"), parsed.alias("expression")).where("occurrence_id is not null")


def occurrences_latest(spark, d):
    return _occurrences(spark, d).select("id", "ecosystem", "name", "selected_version", "declared_range", "evidence_kind", "directness")


def relationships_latest(spark, d):
    return _edges(spark, d).select("parent_id", "child_id", "evidence_status", "activation", "parser")


def nuget_range(spark, d):
    """Bare, exact and interval ranges made of every declared version, against the selected one."""
    o = _occurrences(spark, d).where("declared_range is not null and selected_version is not null")
    declared = F.regexp_replace("declared_range", r"^[\^~>=]+", "")
    ranges = F.array(*[F.struct(F.lit(n).alias("form"), x.alias("range")) for n, x in (
        ("bare", declared), ("exact", F.concat(F.lit("["), declared, F.lit("]"))), ("below", F.concat(F.lit("(,"), declared, F.lit(")"))),
        ("span", F.concat(F.lit("["), declared, F.lit(", 9.0)"))), ("raw", F.col("declared_range")))])
    each = o.select("id", "selected_version", F.inline(ranges))
    return each.select("id", "form", versions.nuget_satisfies(F.col("selected_version"), F.col("range")).alias("admits"))


def range_checks(spark, d):
    """Declared ranges against selected versions by the rules of each ecosystem."""
    o = _occurrences(spark, d).where("declared_range is not null and selected_version is not null")
    v, r = F.col("selected_version"), F.col("declared_range")
    admits = F.when(F.col("ecosystem") == "pypi", F.col("_pep")).otherwise(F.col("_npm"))
    out = o.select("id", "ecosystem", versions.npm_admits(v, r).alias("_npm"), versions.pep440_admits(v, r).alias("_pep"))
    return out.select("id", "ecosystem", admits.alias("admits"))


def unique_match_resolution(spark, d):
    """Names that a package asks for, resolved where exactly one occurrence of the ecosystem and version has it."""
    o = _occurrences(spark, d)
    s = o.where("selected_version is not null").select(F.col("id").alias("selector"), "ecosystem", "name", "selected_version")
    c = o.select(F.col("id").alias("candidate"), "ecosystem", "name", "selected_version")
    return op.unique_by_key(s, c, ["ecosystem", "name", "selected_version"], "selector", "candidate")


def reachability(spark, d):
    return op.reachability(_occurrences(spark, d), _edges(spark, d))


def adjacency(spark, d):
    """Sorted children of every parent."""
    return _edges(spark, d).groupBy("parent_id").agg(F.array_join(F.sort_array(F.collect_set("child_id")), " ").alias("children"))


def name_version_rank(spark, d):
    return op.ranked(_occurrences(spark, d).withColumn("snapshot", F.coalesce("root_id", F.lit(""))), "snapshot")


def occurrence_facets(spark, d):
    return op.facets(_occurrences(spark, d), ["scopes"])


def license_state(spark, d):
    return op.license_states(_occurrences(spark, d), _observations(spark, d))


def license_gaps(spark, d):
    return op.license_gaps(_occurrences(spark, d), _observations(spark, d))


def license_policy(spark, d):
    """Verdict per package by the strictest of its observations."""
    # null is an expression too, the one that is no text
    asked = F.coalesce("expression", F.lit("\x00")).alias("asked")
    o = table(spark, d, "license_observations").select(key("occurrence_id").alias("id"), asked).where("id is not null")
    distinct = o.select("asked").distinct().withColumn("verdict", licenses.evaluated(F.nullif("asked", F.lit("\x00")), POLICY))
    distinct = Workspace(spark, "verdicts").cut(distinct, "verdicts")
    judged = lookup(o, distinct, "asked", written=True).groupBy("id").agg(licenses.strictest(F.col("verdict")).alias("result"))
    return _occurrences(spark, d).select("id").join(judged, "id", "left").select("id", F.coalesce("result", F.lit("undetermined")).alias("result"))


def license_classes(spark, d):
    o = table(spark, d, "license_observations").select("raw").distinct()
    return o.select("raw", licenses.parse_license("raw").alias("p")).select("raw", "p.expression", "p.parse")


def export_components(spark, d):
    return op.exportable(_occurrences(spark, d), _edges(spark, d))[0]


def export_dependencies(spark, d):
    return op.exportable(_occurrences(spark, d), _edges(spark, d))[1]


def export_cyclonedx(spark, d):
    return op.cyclonedx(*op.exportable(_occurrences(spark, d), _edges(spark, d)))


def integrity_violations(spark, d):
    return op.broken(table(spark, d, "occurrences"), table(spark, d, "relationships"), table(spark, d, "license_observations"))


def inventory_summary(spark, d):
    return op.summary(_occurrences(spark, d), _edges(spark, d))


def unique_declared_range(spark, d):
    o = _occurrences(spark, d).where("declared_range is not null")
    return op.unique_range(o.select(F.concat_ws("/", "ecosystem", "name").alias("child"), "declared_range"))


def row_digests(spark, d):
    """Digest of the packages of every root, whatever order they come in."""
    o = _occurrences(spark, d).withColumn("snapshot", F.coalesce("root_id", F.lit("")))
    return op.row_digest(o, ["id"], ["ecosystem", "name", "selected_version"], "snapshot")


def purl_check(spark, d):
    """Package URLs computed anew against those recorded."""
    o = _occurrences(spark, d).where("ecosystem is not null and name is not null")
    made = ids.purl(F.col("ecosystem"), F.col("name"), F.col("selected_version"))
    return o.select("id", made.alias("computed"), F.col("purl").alias("recorded"))


def projected_rows(spark, d):
    return resolution.projected_rows(_occurrences(spark, d), _edges(spark, d), _observations(spark, d)).select("table", "key", "columns")


def selected_versions(spark, d):
    """What all declared ranges of every package name of an ecosystem select, together with the pins of its locked rows."""
    o = _occurrences(spark, d).withColumn("pin", F.when(F.col("evidence_kind") == "locked", F.col("selected_version")))
    asked = o.where("declared_range is not null or pin is not null")
    return resolution.selected_versions(asked.select(F.col("ecosystem").alias("project"), "ecosystem", "name", F.col("declared_range").alias("range"), "pin"))


def lock_files(spark, d):
    """(path, content): a small lock file of every edge between two packages of one ecosystem with a name and version.

    The parent asks for the child by the range that the child's record declares.
    """
    o = _occurrences(spark, d).where("name is not null and selected_version is not null").select("id", "ecosystem", "name", "selected_version", "declared_range")
    side = lambda p: o.select(*[F.col(c).alias(f"{p}_{c}") for c in o.columns])
    e = _edges(spark, d).select("parent_id", "child_id").join(side("child"), "child_id").join(side("parent"), "parent_id").where("parent_ecosystem = child_ecosystem")
    pn, pv, cn, cv, r = (F.col(x) for x in ("parent_name", "parent_selected_version", "child_name", "child_selected_version", "child_declared_range"))
    q = lambda x: F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2)
    asked, folder = F.coalesce(r, F.lit("*")), F.concat_ws("/", F.lit("locks"), "parent_id", "child_id")
    npm = F.concat(F.lit('{"lockfileVersion":3,"packages":{"":{"dependencies":{'), q(pn), F.lit(':"*"}},'), q(F.concat(F.lit("node_modules/"), pn)), F.lit(':{"version":'), q(pv), F.lit(',"dependencies":{'), q(cn), F.lit(":"), q(asked),
                   F.lit("}},"), q(F.concat(F.lit("node_modules/"), pn, F.lit("/node_modules/"), cn)), F.lit(':{"version":'), q(cv), F.lit("}}}"))
    source = F.lit('source = "registry+https://index.example/i"\n')
    toml = lambda n, v, more: F.concat(F.lit("[[package]]\nname = "), q(n), F.lit("\nversion = "), q(v), F.lit("\n"), more)
    cargo = F.concat(toml(pn, pv, F.concat(source, F.lit("dependencies = ["), q(F.concat(cn, F.lit(" "), cv)), F.lit("]\n"))), toml(cn, cv, source))
    poetry = F.concat(toml(pn, pv, F.concat(F.lit("[package.dependencies]\n"), q(cn), F.lit(" = "), q(asked), F.lit("\n"))), toml(cn, cv, F.lit("")))
    plain = F.regexp_replace(asked, r"^[\^~>=*]+", "")
    nuget = F.concat(F.lit('{"dependencies":{"net8.0":{'), q(pn), F.lit(':{"type":"Direct","resolved":'), q(pv), F.lit(',"dependencies":{'), q(cn), F.lit(":"), q(F.when(plain == "", cv).otherwise(plain)), F.lit("}},"), q(cn),
                     F.lit(':{"type":"Transitive","resolved":'), q(cv), F.lit("}}}}"))
    files = {"npm": ("package-lock.json", npm), "cargo": ("Cargo.lock", cargo), "pypi": ("poetry.lock", poetry), "nuget": ("packages.lock.json", nuget)}
    path = content = None
    for ecosystem, (name, text) in files.items():
        of = F.col("child_ecosystem") == ecosystem
        path = F.when(of, F.concat(folder, F.lit(f"/{name}"))) if path is None else path.when(of, F.concat(folder, F.lit(f"/{name}")))
        content = F.when(of, text) if content is None else content.when(of, text)
    return e.select(path.alias("path"), content.alias("content")).where("path is not null")


def _composed(spark, d):
    return composition.composed(packages.read_packages(lock_files(spark, d)))


def composed_selectors(spark, d):
    """What every dependency entry of the lock files resolves to, and why."""
    return _composed(spark, d).selectors.select("path", "name", "declared_range", "exact_version", "disposition", "reason")


def composed_occurrences(spark, d):
    return _composed(spark, d).occurrences.select("path", "ecosystem", "name", "selected_version", "declared_range", "directness")


def composed_coverage(spark, d):
    return _composed(spark, d).coverage.select("path", "format", "disposition", "unresolved", "fidelity")


def composed_summary(spark, d):
    return composition.summary(_composed(spark, d))


def ordered_digests(spark, d):
    """Digest of the packages of every root in the order of their ids."""
    o = _occurrences(spark, d).withColumn("snapshot", F.coalesce("root_id", F.lit("")))
    return stored.ordered_digest(o, ["snapshot"], [F.col("id")], ["id", "ecosystem", "name", "selected_version"])


def config_problems(spark, d):
    """What is wrong with the policy rules as they were typed."""
    rules = table(spark, d, "policy_rules").select(F.col("rule_no").alias("ord"), "severity", "category", F.col("max_count").cast("string").alias("max_count"), "action")
    return config.policy_problems(rules).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        occurrences_latest, relationships_latest, nuget_range, range_checks, unique_match_resolution, reachability, adjacency, name_version_rank, occurrence_facets, license_state,
        license_gaps, license_policy, license_classes, export_components, export_dependencies, export_cyclonedx, integrity_violations, inventory_summary, unique_declared_range,
        row_digests, purl_check, projected_rows, selected_versions, config_problems, composed_selectors, composed_occurrences, composed_coverage, composed_summary, ordered_digests,
    )
}

_T = r"E' \t\r\n\x0b\x0c'"
_K = lambda c: f"nullif(lower(trim({c}, {_T})), '')"
BASE = f"""
WITH oc AS (SELECT {_K('id')} AS id, * EXCLUDE (id) FROM occurrences QUALIFY row_number() OVER (PARTITION BY {_K('id')} ORDER BY recorded_at DESC) = 1),
o AS (SELECT * FROM oc WHERE id IS NOT NULL),
ed AS (SELECT {_K('parent_id')} AS parent_id, {_K('child_id')} AS child_id, evidence_status, activation, source.parser AS parser, recorded_at FROM relationships),
e AS (SELECT * FROM ed WHERE parent_id IS NOT NULL AND child_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY parent_id, child_id ORDER BY recorded_at DESC) = 1),
ob AS (SELECT {_K('occurrence_id')} AS occurrence_id, CASE WHEN parse <> 'unparsed' THEN nullif(trim(expression), '') END AS expression FROM license_observations WHERE {_K('occurrence_id')} IS NOT NULL)
"""
_V = lambda c: f"list_transform(string_split({c}, '.'), lambda x: cast(x AS BIGINT))"
_OK = lambda c: f"regexp_full_match({c}, '[0-9]{{1,10}}(\\.[0-9]{{1,10}}){{0,3}}')"

ORACLES = {
    "occurrences_latest": BASE + "SELECT id, ecosystem, name, selected_version, declared_range, evidence_kind, directness FROM o",
    "relationships_latest": BASE + "SELECT parent_id, child_id, evidence_status, activation, parser FROM e",
    "nuget_range": BASE + rf""", r AS (SELECT id, selected_version AS v, regexp_replace(declared_range, '^[\^~>=]+', '') AS r, declared_range AS raw FROM o WHERE declared_range IS NOT NULL AND selected_version IS NOT NULL),
n AS (SELECT *, {_OK('v')} AND {_OK('r')} AS ok FROM r), p AS (SELECT *, CASE WHEN ok THEN {_V('v')} END AS a, CASE WHEN ok THEN {_V('r')} END AS b FROM n)
SELECT id, 'bare' AS form, CASE WHEN ok THEN a >= b END AS admits FROM p UNION ALL SELECT id, 'exact', CASE WHEN ok THEN a = b END FROM p UNION ALL SELECT id, 'below', CASE WHEN ok THEN a < b END FROM p
UNION ALL SELECT id, 'span', CASE WHEN ok AND b < [9, 0, 0] THEN a >= b AND a < [9, 0, 0] END FROM p UNION ALL SELECT id, 'raw', CASE WHEN {_OK('raw')} THEN a >= b END FROM p""",
    "unique_match_resolution": BASE + """SELECT s.id AS selector, CASE WHEN count(c.id) = 1 THEN min(c.id) END AS candidate, count(c.id) AS matches FROM o s
LEFT JOIN o c ON s.ecosystem = c.ecosystem AND s.name = c.name AND s.selected_version = c.selected_version WHERE s.selected_version IS NOT NULL GROUP BY s.id""",
    "reachability": BASE.replace("WITH oc", "WITH RECURSIVE oc") + """, top AS (SELECT DISTINCT parent_id AS id FROM e WHERE parent_id NOT IN (SELECT child_id FROM e)),
walk AS (SELECT id FROM top UNION SELECT e.child_id FROM walk JOIN e ON e.parent_id = walk.id),
near AS (SELECT DISTINCT child_id AS id FROM e WHERE parent_id IN (FROM top))
SELECT o.id, CASE WHEN o.id IN (FROM near) THEN 'direct' WHEN o.id IN (FROM walk) AND o.id NOT IN (FROM top) THEN 'transitive' ELSE 'unknown' END AS directness FROM o""",
    "adjacency": BASE + "SELECT parent_id, string_agg(child_id, ' ' ORDER BY child_id) AS children FROM e GROUP BY 1",
    "name_version_rank": BASE + "SELECT coalesce(root_id, '') AS snapshot, id, row_number() OVER (PARTITION BY coalesce(root_id, '') ORDER BY coalesce(name, ''), selected_version IS NULL, coalesce(selected_version, ''), id) - 1 AS name_version_rank FROM o",
    "occurrence_facets": BASE + "SELECT DISTINCT id, 'scopes' AS facet, unnest(scopes) AS value FROM o WHERE scopes IS NOT NULL",
    "license_state": BASE + """, g AS (SELECT occurrence_id, bool_or(expression IS NULL) AS open, min(expression) AS a, max(expression) AS b FROM ob GROUP BY 1)
SELECT id, CASE WHEN open IS NULL THEN 'unstated' WHEN open THEN 'unparsed' WHEN a <> b THEN 'conflicting' ELSE 'stated' END AS state, CASE WHEN NOT open AND a = b THEN a END AS expression FROM o LEFT JOIN g ON id = occurrence_id""",
    "license_gaps": BASE + "SELECT id FROM o WHERE id NOT IN (SELECT occurrence_id FROM ob)",
    "export_components": BASE + "SELECT id, name, selected_version AS version, purl, ecosystem FROM o WHERE purl <> '' AND selected_version IS NOT NULL",
    "export_dependencies": BASE + ", p AS (SELECT id FROM o WHERE purl <> '' AND selected_version IS NOT NULL) SELECT parent_id AS ref, child_id AS depends_on FROM e WHERE evidence_status = 'evidenced' AND activation = 'active' AND parent_id IN (FROM p) AND child_id IN (FROM p)",
    "integrity_violations": BASE + f""", i AS (SELECT DISTINCT {_K('id')} AS id FROM occurrences WHERE {_K('id')} IS NOT NULL), x AS (
SELECT 'occurrence-id-missing' AS rule, count(*) AS n FROM occurrences WHERE {_K('id')} IS NULL
UNION ALL SELECT 'occurrence-id-repeated', count(*) FROM (SELECT {_K('id')} FROM occurrences WHERE {_K('id')} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'edge-parent-unknown', count(*) FROM ed WHERE parent_id IS NOT NULL AND parent_id NOT IN (FROM i) UNION ALL SELECT 'edge-child-unknown', count(*) FROM ed WHERE child_id IS NOT NULL AND child_id NOT IN (FROM i)
UNION ALL SELECT 'edge-end-missing', count(*) FROM ed WHERE parent_id IS NULL OR child_id IS NULL UNION ALL SELECT 'edge-to-itself', count(*) FROM ed WHERE parent_id = child_id
UNION ALL SELECT 'license-occurrence-unknown', count(*) FROM ob WHERE occurrence_id NOT IN (FROM i)
UNION ALL SELECT 'installed-without-version', count(*) FROM occurrences WHERE evidence_kind = 'installed' AND selected_version IS NULL) SELECT * FROM x WHERE n > 0""",
    "inventory_summary": BASE + "SELECT (SELECT count(*) FROM o) AS package_occurrences, (SELECT count(selected_version) FROM o) AS selected_occurrences, (SELECT count(*) FROM e) AS canonical_relationships, (SELECT count(*) FROM e WHERE evidence_status = 'evidenced') AS evidenced_relationships",
    "projected_rows": BASE + """SELECT 'occurrence' AS "table", id AS key, cast(to_json({'ecosystem': ecosystem, 'name': name, 'selected_version': selected_version, 'evidence_kind': evidence_kind, 'directness': directness}) AS VARCHAR) AS columns FROM o
UNION ALL SELECT 'occurrence_facet', id || '|scope|' || v, cast(to_json({'facet': 'scope', 'value': v}) AS VARCHAR) FROM (SELECT DISTINCT id, unnest(scopes) AS v FROM o) WHERE v IS NOT NULL
UNION ALL SELECT 'relationship', parent_id || '|' || child_id, cast(to_json({'parent_id': parent_id, 'child_id': child_id, 'evidence_status': evidence_status}) AS VARCHAR) FROM e
UNION ALL SELECT 'evidence', occurrence_id || '|' || coalesce(expression, ''), cast(to_json({'occurrence_id': occurrence_id, 'expression': expression}) AS VARCHAR) FROM (SELECT DISTINCT occurrence_id, expression FROM ob)""",
    "export_cyclonedx": BASE + """, p AS (SELECT * FROM o WHERE purl <> '' AND selected_version IS NOT NULL),
b AS (SELECT parent_id, '["' || string_agg(child_id, '","' ORDER BY child_id) || '"]' AS below FROM (SELECT DISTINCT parent_id, child_id FROM e WHERE evidence_status = 'evidenced' AND activation = 'active' AND parent_id IN (SELECT id FROM p) AND child_id IN (SELECT id FROM p)) GROUP BY 1)
SELECT id, '{"bom-ref":' || to_json(id) || ',"type":"library"' || coalesce(',"name":' || to_json(name), '') || ',"version":' || to_json(selected_version) || ',"purl":' || to_json(purl) || coalesce(',"dependsOn":' || below, '') || '}' AS component FROM p LEFT JOIN b ON parent_id = id""",
    "row_digests": BASE + """, t AS (SELECT coalesce(root_id, '') AS snapshot, sha256(concat_ws(chr(31), (id IS NULL)::VARCHAR, coalesce(id, ''), (ecosystem IS NULL)::VARCHAR, coalesce(ecosystem, ''), (name IS NULL)::VARCHAR, coalesce(name, ''), (selected_version IS NULL)::VARCHAR, coalesce(selected_version, ''))) AS h FROM o),
g AS (SELECT snapshot, count(*) AS n, """ + ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT) AS s{i}" for i in range(8)) + """ FROM t GROUP BY 1)
SELECT snapshot, n, sha256(concat_ws(':', n, """ + ", ".join(f"s{i}" for i in range(8)) + """)) AS digest FROM g""",
    "config_problems": f"""WITH r AS (SELECT rule_no AS ord, {_K('severity')} AS s, {_K('category')} AS c, {_K('action')} AS a, max_count AS m FROM policy_rules), x AS (
SELECT ord, 'bad-severity' AS problem FROM r WHERE s NOT IN ('critical','high','medium','low') UNION ALL SELECT ord, 'bad-category' FROM r WHERE c NOT IN ({", ".join(map(repr, config.POLICY_CATEGORIES))})
UNION ALL SELECT ord, 'no-action' FROM r WHERE a IS NULL UNION ALL SELECT ord, 'bad-action' FROM r WHERE a NOT IN ('fail','warn','ignore') UNION ALL SELECT ord, 'bad-limit' FROM r WHERE m < 0)
SELECT DISTINCT 'policy' AS section, ord, problem FROM x""",
    "unique_declared_range": BASE + "SELECT concat_ws('/', ecosystem, name) AS child, min(declared_range) AS declared_range FROM o WHERE declared_range IS NOT NULL GROUP BY 1 HAVING count(DISTINCT declared_range) = 1",
}

#: What the lock files of `lock_files` come to, from the edges; versions and ranges of the tables are plain numbers.
_LOCKS = BASE + r""", j AS (
  SELECT 'locks/' || p.id || '/' || k.id AS folder, k.ecosystem AS eco, p.name AS pn, p.selected_version AS pv, k.name AS cn, k.selected_version AS cv, k.declared_range AS r
  FROM e JOIN o p ON p.id = e.parent_id JOIN o k ON k.id = e.child_id WHERE p.ecosystem = k.ecosystem AND p.name IS NOT NULL AND k.name IS NOT NULL AND p.selected_version IS NOT NULL AND k.selected_version IS NOT NULL),
n AS (SELECT * REPLACE (CASE eco WHEN 'pypi' THEN lower(regexp_replace(pn, '[-_.]+', '-', 'g')) WHEN 'nuget' THEN lower(pn) ELSE pn END AS pn, CASE eco WHEN 'pypi' THEN lower(regexp_replace(cn, '[-_.]+', '-', 'g')) WHEN 'nuget' THEN lower(cn) ELSE cn END AS cn),
  folder || CASE eco WHEN 'npm' THEN '/package-lock.json' WHEN 'cargo' THEN '/Cargo.lock' WHEN 'pypi' THEN '/poetry.lock' ELSE '/packages.lock.json' END AS path,
  CASE WHEN eco = 'nuget' AND regexp_replace(coalesce(r, ''), '^[\^~>=]+', '') = '' THEN cv WHEN eco = 'nuget' THEN regexp_replace(r, '^[\^~>=]+', '') ELSE coalesce(r, '*') END AS asked FROM j WHERE eco IN ('npm', 'cargo', 'pypi', 'nuget')),
b AS (SELECT *, eco = 'nuget' AND pn = cn AS broken,
  list_transform(string_split(cv, '.'), lambda x: cast(x AS BIGINT)) AS v, list_transform(string_split(pv, '.'), lambda x: cast(x AS BIGINT)) AS u, list_transform(string_split(regexp_replace(CASE WHEN asked = '*' THEN '0.0.0' ELSE asked END, '^[\^~>=]+', ''), '.'), lambda x: cast(x AS BIGINT)) AS w FROM n),
t AS (SELECT *, CASE WHEN asked LIKE '^%' AND w[1] > 0 THEN [w[1] + 1, 0, 0] WHEN asked LIKE '^%' AND w[2] > 0 THEN [0, w[2] + 1, 0] WHEN asked LIKE '^%' THEN [0, 0, w[3] + 1] WHEN asked LIKE '~%' THEN [w[1], w[2] + 1, 0] ELSE [99999999, 0, 0] END AS top FROM b),
ok AS (SELECT *, v >= w AND v < top AS fits, u >= w AND u < top AS pfits, regexp_full_match(cn, x) AS good, regexp_full_match(pn, x) AS pgood FROM (SELECT *, CASE eco WHEN 'npm' THEN '(@[^/@]+/)?[^/@]+' WHEN 'pypi' THEN '[a-z0-9]+(-[a-z0-9]+)*' ELSE '[^/@]+' END AS x FROM t)),
a AS (SELECT *, CASE eco
  WHEN 'npm' THEN CASE WHEN NOT good THEN 'npm-source-endpoint-not-admitted' WHEN fits THEN 'unique-source-endpoint' ELSE 'npm-selector-version-mismatch' END
  WHEN 'cargo' THEN CASE WHEN pn = cn AND pv = cv THEN 'ambiguous-cargo-lock-selector' WHEN good THEN 'unique-source-endpoint' ELSE 'cargo-source-endpoint-not-admitted' END
  WHEN 'nuget' THEN CASE WHEN NOT good THEN 'missing-nuget-lock-endpoint' WHEN v >= w THEN 'source-nuget-lock-endpoint' ELSE 'contradictory-nuget-dependency-range' END
  ELSE CASE WHEN fits::INT + (pn = cn AND pfits)::INT > 1 THEN 'ambiguous-lock-dependency' WHEN good AND (fits OR (pn = cn AND pfits)) THEN 'unambiguous-lock-selection' ELSE 'missing-lock-dependency' END END AS reason FROM ok),
c AS (SELECT *, reason IN ('unique-source-endpoint', 'source-nuget-lock-endpoint', 'unambiguous-lock-selection') AS yes FROM a),
sel AS (SELECT path, cn AS name, CASE WHEN eco = 'cargo' THEN NULL ELSE asked END AS declared_range, CASE WHEN yes THEN CASE WHEN eco = 'pypi' AND NOT fits THEN pv ELSE cv END END AS exact_version, CASE WHEN yes THEN 'resolved' ELSE 'unresolved' END AS disposition, reason FROM c WHERE NOT broken AND pgood
  UNION ALL SELECT path, pn, '*', CASE WHEN pgood THEN pv END, CASE WHEN pgood THEN 'resolved' ELSE 'unresolved' END, CASE WHEN pgood THEN 'unique-source-endpoint' ELSE 'npm-source-endpoint-not-admitted' END FROM c WHERE eco = 'npm')
"""
ORACLES["composed_selectors"] = _LOCKS + "SELECT path, name, declared_range, exact_version, disposition, reason FROM sel"
ORACLES["composed_occurrences"] = _LOCKS + """SELECT path, eco AS ecosystem, pn AS name, pv AS selected_version, CASE WHEN eco = 'npm' THEN '*' END AS declared_range, CASE WHEN eco IN ('npm', 'nuget') THEN 'direct' ELSE 'unknown' END AS directness FROM c WHERE NOT broken AND pgood
UNION ALL SELECT path, eco, cn, cv, NULL, CASE WHEN eco = 'nuget' OR (eco = 'npm' AND yes AND pgood) THEN 'transitive' ELSE 'unknown' END FROM c WHERE NOT broken AND good"""
ORACLES["composed_coverage"] = _LOCKS + """, un AS (SELECT path, count(*) AS missed FROM sel WHERE disposition = 'unresolved' GROUP BY 1)
SELECT path, CASE eco WHEN 'npm' THEN 'npm-lock' WHEN 'cargo' THEN 'cargo-lock' WHEN 'pypi' THEN 'python-poetry-lock' ELSE 'nuget-lock' END AS format, CASE WHEN broken THEN 'failed' ELSE 'parsed' END AS disposition, coalesce(missed, 0) AS unresolved,
  CASE WHEN broken THEN 'failed' WHEN coalesce(missed, 0) = 0 THEN 'complete' ELSE 'partial' END AS fidelity FROM c LEFT JOIN un USING (path)"""
ORACLES["composed_summary"] = _LOCKS + """, d AS (SELECT CASE WHEN broken THEN 'failed' ELSE 'parsed' END AS disposition FROM c),
oc2 AS (SELECT path FROM c WHERE NOT broken AND pgood UNION ALL SELECT path FROM c WHERE NOT broken AND good)
SELECT 'input_dispositions.' || x AS name, (SELECT count(*) FROM d WHERE disposition = x) AS n FROM (SELECT unnest(""" + repr(composition.DISPOSITIONS) + """) AS x)
UNION ALL SELECT unnest(['discovered_inputs', 'recognized_inputs']), (SELECT count(*) FROM c) UNION ALL SELECT unnest(['package_occurrences', 'selected_occurrences']), (SELECT count(*) FROM oc2)
UNION ALL SELECT unnest(['canonical_relationships', 'evidenced_relationships']), (SELECT count(*) FROM c WHERE yes AND pgood AND NOT broken) UNION ALL SELECT unnest(['declarations', 'canonical_projection_losses']), 0"""
ORACLES["ordered_digests"] = BASE + """, r AS (SELECT coalesce(root_id, '') AS snapshot, id, sha256(cast(to_json({'id': id, 'ecosystem': ecosystem, 'name': name, 'selected_version': selected_version}) AS VARCHAR)) AS d FROM o),
p AS (SELECT *, row_number() OVER (PARTITION BY snapshot ORDER BY id) - 1 AS pos FROM r), a AS (SELECT snapshot, pos // 1024 AS blk, sha256(string_agg(d, '' ORDER BY pos)) AS d FROM p GROUP BY snapshot, pos // 1024),
b AS (SELECT snapshot, CASE WHEN count(*) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY blk)) END AS digest FROM a GROUP BY 1)
SELECT snapshot, n, digest FROM b JOIN (SELECT snapshot, count(*) AS n FROM r GROUP BY 1) USING (snapshot)"""
#: Versions and ranges of the tables are plain numbers under ^, ~ or >=, which the rules of pypi and npm read alike.
ORACLES["range_checks"] = BASE + r""", b AS (SELECT id, ecosystem, declared_range AS r, list_transform(string_split(selected_version, '.'), lambda x: cast(x AS BIGINT)) AS v,
  list_transform(string_split(regexp_replace(declared_range, '^[\^~>=]+', ''), '.'), lambda x: cast(x AS BIGINT)) AS w FROM o WHERE declared_range IS NOT NULL AND selected_version IS NOT NULL)
SELECT id, ecosystem, v >= w AND v < CASE WHEN r LIKE '^%' AND w[1] > 0 THEN [w[1] + 1, 0, 0] WHEN r LIKE '^%' AND w[2] > 0 THEN [0, w[2] + 1, 0] WHEN r LIKE '^%' THEN [0, 0, w[3] + 1] WHEN r LIKE '~%' THEN [w[1], w[2] + 1, 0] ELSE [99999999, 0, 0] END AS admits FROM b"""
ORACLES["purl_check"] = BASE + """, x AS (SELECT *, CASE ecosystem WHEN 'npm' THEN '(@[^/@]+/)?[^/@]+' WHEN 'pypi' THEN '[a-z0-9]+(-[a-z0-9]+)*' ELSE '[^/@]+' END AS rule FROM o WHERE ecosystem IS NOT NULL AND name IS NOT NULL)
SELECT id, CASE WHEN regexp_full_match(name, rule) AND (ecosystem <> 'nuget' OR name = lower(name)) THEN 'pkg:' || ecosystem || '/' || replace(name, '@', '%40') || coalesce('@' || selected_version, '') END AS computed, purl AS recorded FROM x"""

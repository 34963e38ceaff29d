"""Resolution inside one project: what a set of declarations selects, origins of cyclic includes, row projections.

Groups here are one project's declarations of one name, or one repository's include files: bounded by
what a person wrote, and reduced to distinct rows before they are grouped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lodestrata.functions import versions

SELECTED = "project string, name string, version string, reason string"


def _select(batch: pd.DataFrame) -> pd.DataFrame:
    project, name, ecosystem = (batch[c].iloc[0] for c in ("project", "name", "ecosystem"))

    def result(version, reason):
        return pd.DataFrame([(project, name, version, reason)], columns=["project", "name", "version", "reason"])

    rules = versions.RULES.get(ecosystem, versions.NPM)
    ranges = sorted({r for r in batch["range"] if r and r.strip()})
    pinned = {rules.order(v): v for v in sorted({v for v in batch["pin"] if v is not None}, reverse=True)}
    if None in pinned or not all(rules.readable(r) for r in ranges):
        return result(None, "invalid")
    exact = pinned or {rules.order(v): v for r in reversed(ranges) for v in rules.exact(r)}
    if not exact:
        return result(None, "open")
    if len(pinned) > 1:
        return result(None, "conflict")
    fitting = [v for v in exact.values() if all(rules.admits(v, r) for r in ranges)]
    return result(rules.shown(fitting[0]), "selected") if len(fitting) == 1 else result(None, "conflict")


def selected_versions(declarations: DataFrame) -> DataFrame:
    """(project, name, version, reason) of declarations (project, name, range): all ranges of a name together.

    Two more columns are read if there: `pin`, a version that a lock names, and `ecosystem`, by whose rules
    ranges are read (pypi where the column is missing); names of different ecosystems are apart.
    selected: one exact version satisfies all; conflict: exact versions that exclude each other or a
    range; open: nothing is pinned; invalid: a range or a pin can't be read. Null and blank ranges ask for nothing.
    """
    given = declarations.columns
    pin = F.col("pin") if "pin" in given else F.lit(None).cast("string").alias("pin")
    ecosystem = F.col("ecosystem") if "ecosystem" in given else F.lit("pypi").alias("ecosystem")
    distinct = declarations.select("project", "name", ecosystem, "range", pin).where("project is not null and name is not null").distinct()
    return distinct.groupBy("project", "ecosystem", "name").applyInPandas(_select, SELECTED)


def _origins(batch: pd.DataFrame) -> pd.DataFrame:
    nodes = sorted({*batch["parent"], *batch["child"]})
    below: dict[str, list[str]] = {n: [] for n in nodes}
    for p, c in zip(batch["parent"], batch["child"]):
        below[p].append(c)
    # Tarjan's lowlinks with an explicit stack: one pass, any depth
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    held: list[str] = []
    on, group = set(), {}
    for root in nodes:
        if root in index:
            continue
        work: list[tuple[str, Iterator[str]]] = [(root, iter(below[root]))]
        index[root] = low[root] = len(index)
        held.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            nxt = next(rest, None)
            if nxt is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while True:
                        m = held.pop()
                        on.discard(m)
                        members.append(m)
                        if m == node:
                            break
                    for m in members:
                        group[m] = min(members)
            elif nxt not in index:
                index[nxt] = low[nxt] = len(index)
                held.append(nxt)
                on.add(nxt)
                work.append((nxt, iter(below[nxt])))
            elif nxt in on:
                low[node] = min(low[node], index[nxt])
    entered = {group[c] for p, c in zip(batch["parent"], batch["child"]) if group[p] != group[c]}
    rows = [(batch["project"].iloc[0], n, group[n], group[n] not in entered) for n in nodes]
    return pd.DataFrame(rows, columns=["project", "node", "component", "is_origin"])


def include_origins(edges: DataFrame) -> DataFrame:
    """(project, node, component, is_origin) of include edges (project, parent, child).

    Files that include each other in circles are one component, named by its smallest member; a
    component that no other includes is an origin.
    """
    distinct = edges.select("project", "parent", "child").dropna().distinct()
    return distinct.groupBy("project").applyInPandas(_origins, "project string, node string, component string, is_origin boolean")


def lock_roots(manifests: DataFrame, locks: DataFrame) -> DataFrame:
    """(path, agrees): whether a lock's declared tables (path, name, range, scope) equal those of its manifest.

    Both sides are reduced to an order-free digest per path, so no table is ever held as a list.
    """
    from lodestrata.operators.inventory import row_digest

    a = row_digest(manifests.distinct(), ["name"], ["range", "scope"], "path").select("path", F.col("digest").alias("_a"))
    b = row_digest(locks.distinct(), ["name"], ["range", "scope"], "path").select("path", F.col("digest").alias("_b"))
    return b.join(a, "path", "left").select("path", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("agrees"))


def projected_rows(occurrences: DataFrame, edges: DataFrame, observations: DataFrame) -> DataFrame:
    """(table, key, columns): the inventory normalised into one keyed row format, each row once."""
    row = lambda table, key, *names: F.struct(F.lit(table).alias("table"), key.alias("key"), F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("columns"))
    c = F.col
    a = occurrences.select(row("occurrence", c("id"), "ecosystem", "name", "selected_version", "evidence_kind", "directness").alias("r"))
    b = occurrences.select("id", F.explode(F.array_distinct("scopes")).alias("value")).where("value is not null")
    b = b.select(row("occurrence_facet", F.concat_ws("|", "id", F.lit("scope"), "value"), F.lit("scope").alias("facet"), "value").alias("r"))
    d = edges.select(row("relationship", F.concat_ws("|", "parent_id", "child_id"), "parent_id", "child_id", "evidence_status").alias("r"))
    e = observations.select("occurrence_id", "expression").distinct().select(row("evidence", F.concat_ws("|", "occurrence_id", F.coalesce("expression", F.lit(""))), "occurrence_id", "expression").alias("r"))
    return a.unionAll(b).unionAll(d).unionAll(e).select("r.*")

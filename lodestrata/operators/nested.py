"""Deeply nested reports as related flat tables that keep the way to their parent.

Bodies are parsed once into VARIANT values inside the JVM. A tree automaton classifies
every object bottom-up by the shape of its members: the state of a value is one of `SHAPES`, the
state of an object names the states of the members it is routed on. `TRANSITIONS` says which typed
subtype each state leads to (a dependency of a map, of a list, a single one, ...); `routed` sends every
member there, and the subtype alone decides how it is read. All subtypes share the supertype's columns:
report_id, entity, parent_path, item.

Defined results: of several deliveries of a report_id the latest readable one counts (ties: the
greater body hash); a byte order mark is passed over; a report inside another object, list or JSON
text, however deep, counts as itself; a body that is null, empty, broken or no report
gives nothing; missing and null members are empty lists; a single value where a list is usual is a
list of one; positions count null entries; a null report_id is one report of its own.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

#: States of a single value.
SHAPES = ("absent", "null", "list", "object", "value")
#: (kind of object, member, state of the member) -> subtype. Members in other states hold nothing.
TRANSITIONS = {
    ("artifact", "locations", "list"): "location_list",
    ("artifact", "locations", "object"): "location_single",
    ("artifact", "locations", "value"): "location_single",
    ("artifact", "dependencies", "object"): "dependency_map",
    ("artifact", "dependencies", "list"): "dependency_list",
    ("artifact", "dependencies", "value"): "dependency_single",
    ("result", "message", "object"): "message_object",
    ("result", "message", "value"): "message_text",
}


def member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def as_list_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def as_map_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def text(v: Column) -> Column:
    """A scalar as text; null for absent and JSON null."""
    return F.when(~F.coalesce(F.is_variant_null(v), F.lit(True)), F.try_variant_get(v, "$", "string"))


def shape(v: Column) -> Column:
    return (
        F.when(v.isNull(), "absent")
        .when(F.is_variant_null(v), "null")
        .when(as_list_of(v).isNotNull(), "list")
        .when(as_map_of(v).isNotNull(), "object")
        .otherwise("value")
    )


def listed(v: Column) -> Column:
    """The entries of a list; a single value as a list of one; nothing as an empty list."""
    none = F.array().cast("array<variant>")
    return F.when(v.isNull() | F.is_variant_null(v), none).otherwise(F.coalesce(as_list_of(v), F.array(v)))


def is_report(v: Column) -> Column:
    return member(v, "artifacts").isNotNull() | member(v, "runs").isNotNull()


def _holds(x) -> bool:
    return isinstance(x, dict) and ("artifacts" in x or "runs" in x)


def opened(body: str | None) -> str | None:
    """The first report inside other objects, lists or JSON texts, nearest first, as JSON text."""
    level = [body]
    while level:
        below = []
        for x in level:
            if _holds(x):
                return json.dumps(x)
            if isinstance(x, str) and x.lstrip("\ufeff \t\r\n")[:1] in ("{", "[", '"'):
                try:
                    below.append(json.loads(x.lstrip("\ufeff")))
                except (ValueError, RecursionError):
                    pass
            elif isinstance(x, dict):
                below.extend(x.values())
            elif isinstance(x, list):
                below.extend(x)
        level = below
    return None


@F.pandas_udf(StringType())
def _opened(body: pd.Series) -> pd.Series:
    return body.map(opened, na_action="ignore").astype(object)


# else the filter on its result is pushed below it, and every body is opened twice
_opened = _opened.asNondeterministic()


def latest_reports(raw: DataFrame) -> DataFrame:
    """(report_id, received_at, report) of the latest readable delivery of each report.

    Bodies that are reports themselves are parsed in the JVM; only the few others go through
    Python, which opens wrappers of any depth (a level of them at a time, so in linear time).
    """
    v = F.col("_v")
    plain = F.coalesce(is_report(v), F.lit(False))
    df = raw.select("report_id", "received_at", "body", F.try_parse_json(F.regexp_replace("body", "^\ufeff", "")).alias("_v"))
    df = df.select("report_id", "received_at", F.xxhash64("body").alias("_h"), F.when(plain, v).alias("_v"), _opened(F.when(~plain, F.col("body"))).alias("_o"))
    df = df.select("report_id", "received_at", "_h", F.coalesce("_v", F.try_parse_json("_o")).alias("report")).where("report is not null")
    return df.groupBy("report_id").agg(F.max("received_at").alias("received_at"), F.max_by("report", F.struct("received_at", "_h")).alias("report"))


def members(entity: str, node: Column) -> dict[str, Column]:
    """The members that an object of this kind is routed on."""
    if entity == "artifact":
        return {"locations": member(node, "locations"), "dependencies": member(member(node, "metadata"), "dependencies")}
    return {"message": member(node, "message")}


def objects(reports: DataFrame) -> DataFrame:
    """The supertype table: (report_id, entity, parent_path, node, state) of every artifact and result.

    `state` is the automaton's state of the object: the states of the members that it is routed on.
    """
    node = lambda entity, path, x: F.struct(F.lit(entity).alias("entity"), path.alias("parent_path"), x.alias("node"))
    artifacts = F.transform(listed(member(F.col("report"), "artifacts")), lambda a, i: node("artifact", F.concat(F.lit("artifacts["), i.cast("string"), F.lit("]")), a))
    results = F.flatten(
        F.transform(
            listed(member(F.col("report"), "runs")),
            lambda r, i: F.transform(
                listed(member(r, "results")),
                lambda x, j: node("result", F.concat(F.lit("runs["), i.cast("string"), F.lit("].results["), j.cast("string"), F.lit("]")), x),
            ),
        )
    )
    out = reports.select("report_id", F.inline(F.concat(artifacts, results)))

    def of(entity: str) -> Column:
        return F.concat_ws("/", *[x for name, v in members(entity, F.col("node")).items() for x in (F.lit(name), shape(v))])

    return out.withColumn("state", F.when(F.col("entity") == "artifact", of("artifact")).otherwise(of("result")))


def routed(nodes: DataFrame) -> DataFrame:
    """(report_id, parent_path, subtype, value): every member that its object's state sends to a subtype table."""
    none = F.array().cast("array<struct<subtype:string,value:variant>>")

    def routes(entity: str) -> Column:
        out = []
        for name, v in members(entity, F.col("node")).items():
            subtype = F.lit(None).cast("string")
            for (kind, of, state), to in TRANSITIONS.items():
                if (kind, of) == (entity, name):
                    # the state names its members, none of which is part of another's name
                    subtype = F.when(F.col("state").contains(f"{name}/{state}"), F.lit(to)).otherwise(subtype)
            out.append(F.struct(subtype.alias("subtype"), v.alias("value")))
        return F.filter(F.array(*out), lambda r: r.subtype.isNotNull())

    sent = F.when(F.col("entity") == "artifact", routes("artifact")).when(F.col("entity") == "result", routes("result")).otherwise(none)
    return nodes.select("report_id", "parent_path", F.inline(sent))


def _leaf(entity: str, item: Column, leaf: Column) -> Column:
    return F.struct(F.lit(entity).alias("entity"), item.alias("item"), leaf.alias("leaf"))


def _of_list(v: Column) -> Column:
    return F.coalesce(as_list_of(v), F.array().cast("array<variant>"))


def _dependency(x: Column) -> Column:
    """An entry of a list: {name, range} or a bare name."""
    name = F.coalesce(text(member(x, "name")), F.when(as_map_of(x).isNull(), text(x)))
    return _leaf("dependency", name, F.coalesce(text(member(x, "range")), F.lit("")))


#: How a member of each subtype is read.
SUBTYPES = {
    "location_list": lambda v: F.transform(_of_list(v), lambda x, i: _leaf("location", i.cast("string"), text(member(x, "path")))),
    "location_single": lambda v: F.array(_leaf("location", F.lit("0"), text(member(v, "path")))),
    "dependency_map": lambda v: F.transform(F.map_entries(as_map_of(v)), lambda e: _leaf("dependency", e.key, F.coalesce(text(e.value), F.lit("")))),
    "dependency_list": lambda v: F.array_distinct(F.transform(_of_list(v), _dependency)),
    "dependency_single": lambda v: F.array(_dependency(v)),
    "message_object": lambda v: F.array(_leaf("message", F.lit(""), text(member(v, "text")))),
    "message_text": lambda v: F.array(_leaf("message", F.lit(""), text(v))),
}


def subtype_table(routes: DataFrame, subtype: str) -> DataFrame:
    """(report_id, entity, parent_path, item, leaf) of one subtype: its typed table."""
    rows = routes.where(F.col("subtype") == subtype).select("report_id", "parent_path", F.inline(SUBTYPES[subtype](F.col("value"))))
    return rows.where("item is not null and leaf is not null").select("report_id", "entity", "parent_path", "item", "leaf")


def leaves(nodes: DataFrame) -> DataFrame:
    """(report_id, entity, parent_path, item, leaf): the subtype tables together, in one pass over the routes."""
    v, read = F.col("value"), None
    for subtype, extract in SUBTYPES.items():
        is_it = F.col("subtype") == subtype
        read = F.when(is_it, extract(v)) if read is None else read.when(is_it, extract(v))
    rows = routed(nodes).select("report_id", "parent_path", F.inline(read)).where("item is not null and leaf is not null")
    return rows.select("report_id", "entity", "parent_path", "item", "leaf")


def artifacts_table(nodes: DataFrame) -> DataFrame:
    """Typed parent table of the artifacts, with the structural variant of each."""
    n = F.col("node")
    return nodes.where("entity = 'artifact'").select(
        "report_id", F.col("parent_path").alias("path"), "state", *[text(member(n, c)).alias(c) for c in ("id", "name", "version", "type", "purl")]
    )


def results_table(nodes: DataFrame) -> DataFrame:
    """Typed parent table of the results, with the structural variant of each."""
    n = F.col("node")
    at = F.try_variant_get(n, "$.locations[0].physicalLocation", "variant")
    return nodes.where("entity = 'result'").select(
        "report_id",
        F.col("parent_path").alias("path"),
        "state",
        text(member(n, "ruleId")).alias("rule_id"),
        text(member(n, "level")).alias("level"),
        text(member(member(at, "artifactLocation"), "uri")).alias("uri"),
        F.try_variant_get(at, "$.region.startLine", "long").alias("start_line"),
    )


def edges_table(reports: DataFrame) -> DataFrame:
    """(report_id, parent, child, type) of artifactRelationships."""
    edge = F.explode(listed(member(F.col("report"), "artifactRelationships")))
    return reports.select("report_id", edge.alias("e")).select("report_id", *[text(member(F.col("e"), c)).alias(c) for c in ("parent", "child", "type")])

"""What changed between full snapshots of a table.

`SnapshotIndex` keeps an index (series, key) -> hash of the last snapshot of every series, as a table
bucketed by (series, key). A delivery brings one or more following snapshots of any series, reduced to
hashes and bucketed alike. Its first snapshots are probed against the index; each later one against
the one before it, bucket by bucket in order of the snapshots, so the rows of a delivery move
once. Old values are fetched only for keys that changed; then the last snapshots of the delivery
become the index: they are written beside the old one, which is removed after the swap.

A series is a project, a snapshot one of its scans. The key of every shuffle is (series, key), which has
one row per snapshot after `latest_per_key`, however the rows spread over snapshots and deliveries.
Defined results: a null key is refused by the caller's filter (a snapshot row needs a key); repeated
rows collapse to the latest delivery, ties to the larger hash; an empty snapshot removes everything
of the one before; a first snapshot has no cases; a series that a delivery leaves out keeps its entries.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lodestrata.functions.ids import compute_finding_id
from lodestrata.functions.text import key
from lodestrata.operators.joins import lookup, partitions_of
from lodestrata.storage import Workspace, shared_folder


def latest_per_key(rows: DataFrame, keys: Sequence[str], version: str, hashed: str, present: str) -> DataFrame:
    """One row per key: the hash of its latest version, null where that version says it is absent.

    The maximum of one struct is combined on the map side, so repeated deliveries of a hot key
    never travel.
    """
    latest = F.max(F.struct(F.col(version), F.col(hashed), F.col(present)))
    return (
        rows.groupBy(*keys)
        .agg(latest.alias("_latest"))
        .where(F.col(f"_latest.{present}"))
        .select(*keys, F.col(f"_latest.{hashed}").alias("hash"))
    )


def scan_order(scans: DataFrame) -> DataFrame:
    """(scan_id, project, nth, _next, _has_previous): each recorded scan with its place in its project and the next one.

    A scan delivered twice counts once. Projects are compared trimmed and in lower case; scans
    without id, project or time have no place in an order and are left out. Only the scans are
    windowed (a few columns of the small side), never the findings.
    """
    one = (
        scans.select("scan_id", key("project").alias("project"), F.col("scan_timestamp").alias("_at"))
        .where("scan_id is not null and project is not null and _at is not null")
        .groupBy("scan_id")
        .agg(F.max(F.struct("_at", "project")).alias("_s"))
        .select("scan_id", "_s.project", "_s._at")
    )
    w = W.partitionBy("project").orderBy("_at", "scan_id")
    return one.select(
        "scan_id",
        "project",
        F.row_number().over(w).alias("nth"),
        F.lead("scan_id").over(w).alias("_next"),
        F.lag("scan_id").over(w).isNotNull().alias("_has_previous"),
    )


def finding_key():
    """The finding's id, or the one computed from rule, path and line where it is missing."""
    return F.coalesce(key("finding_id"), compute_finding_id(F.col("rule_id"), F.col("file"), F.col("line")))


def finding_states(findings: DataFrame, *also: str) -> DataFrame:
    """(also, key, _at, _state, _present) of every delivered row, values reduced to a hash.

    The hash covers severity and category (trimmed, lower case, null as empty) and the payload
    members message, fix_type and effort_mins (missing as null). A payload that is no JSON object
    has no members. 64 bits decide "changed": two different states of one key collide with 2^-64.
    """
    payload = F.from_json("payload", "message string, fix_type string, effort_mins string")
    slim = findings.select(
        *also,
        finding_key().alias("key"),
        F.col("ingested_at").alias("_at"),
        F.coalesce(key("severity"), F.lit("")).alias("_severity"),
        F.coalesce(key("category"), F.lit("")).alias("_category"),
        payload.alias("_p"),
        F.coalesce(key("trend") != "resolved", F.lit(True)).alias("_present"),
    )
    members = [F.col(f"_p.{m}") for m in ("message", "fix_type", "effort_mins")]
    # xxhash64 passes over nulls, so each member is preceded by a flag that tells null from text
    flagged = [x for m in members for x in (m.isNull(), m)]
    return slim.select(*also, "key", "_at", F.xxhash64("_severity", "_category", *flagged).alias("_state"), "_present")


def finding_changes(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """(scan_id, finding_id, change) for each two consecutive scans of a project; scan_id is the later one.

    Two deliveries: all scans but each project's last build the index, then the last scans are probed against it.
    """
    work = Workspace(findings.sparkSession, "changes")
    index = SnapshotIndex(findings.sparkSession, f"{work.root}/index")
    order = work.cut(scan_order(scans).select(F.col("scan_id").alias("snapshot"), F.col("project").alias("series"), "nth", F.col("_next").isNull().alias("last")), "order")
    out = None
    for last in (False, True):
        slots = numbered(order.where(F.col("last") == last))
        rows = lookup(findings, slots.withColumnRenamed("snapshot", "scan_id"), "scan_id", written=True)
        states = latest_per_key(finding_states(rows, "series", "i", "m"), ["series", "i", "m", "key"], "_at", "_state", "_present")
        changes = index.deliver(states, slots)
        out = changes if out is None else out.unionByName(changes)
    return out.select(F.col("snapshot").alias("scan_id"), F.col("key").alias("finding_id"), "change")


def changed_values(findings: DataFrame, scans: DataFrame, changes: DataFrame, names: Sequence[str]) -> DataFrame:
    """(scan_id, finding_id, change, old, new): the values of both scans, fetched only for findings that changed.

    `changes`: rows of `finding_changes`, written. `old` and `new` are structs of the columns `names`, as
    delivered last; null where the scan lacks the finding.
    """
    order = scan_order(scans)
    before = order.where("_next is not null").select(F.col("_next").alias("scan_id"), F.col("scan_id").alias("old_scan"))
    wanted = lookup(changes, before, "scan_id")
    both = wanted.select("finding_id", F.inline(F.array(F.struct(F.col("scan_id").alias("scan_id")), F.struct(F.col("old_scan").alias("scan_id")))))
    rows = findings.where("scan_id is not null").withColumn("finding_id", finding_key()).join(both.distinct(), ["scan_id", "finding_id"], "left_semi")
    present = F.coalesce(key("trend") != "resolved", F.lit(True)).alias("present")
    latest = rows.groupBy("scan_id", "finding_id").agg(F.max(F.struct("ingested_at", F.struct(*names).alias("value"), present)).alias("_l")).where("_l.present")
    value = lambda scan, name: latest.select(F.col("scan_id").alias(scan), "finding_id", F.col("_l.value").alias(name))
    out = wanted.join(value("scan_id", "new"), ["scan_id", "finding_id"], "left").join(value("old_scan", "old"), ["old_scan", "finding_id"], "left")
    return out.select("scan_id", "finding_id", "change", "old", "new")


def numbered(order: DataFrame) -> DataFrame:
    """(snapshot, series, i, m): the place of each snapshot of a delivery in its series, and how many the series has.

    `order`: (snapshot, series, nth), one row per snapshot.
    """
    w = W.partitionBy("series")
    return order.select("snapshot", "series", F.row_number().over(w.orderBy("nth")).alias("i"), F.count(F.lit(1)).over(w).cast("int").alias("m"))


_STATES = "series string, i int, m int, key string, hash long"
_ENTRIES = "series string, key string, hash long"


class SnapshotIndex:
    """The index of the last snapshots, kept between deliveries as a table bucketed by (series, key).

    A version is published by its marker file; a run that dies before leaves the old version in force, and
    what it wrote is overwritten by the next run. The data of older versions is removed after the swap.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, (path or f"{shared_folder(spark)}/snapshot-index").rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.work = Workspace(spark, "snapshots")

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _published(self) -> list[tuple[int, int]]:
        """(version, its buckets) in order."""
        if not self._fs().exists(self._at("")):
            return []
        names = [s.getPath().getName() for s in self._fs().listStatus(self._at(""))]
        return sorted(tuple(map(int, n.removesuffix(".current").split("-"))) for n in names if n.endswith(".current"))

    def versions(self) -> list[int]:
        """Every version that was in force so far; the last one is."""
        return [v for v, _ in self._published()]

    def _table(self, path: str, schema: str, buckets: int) -> DataFrame:
        """A bucketed table; the catalog's entry is needed only to read it."""
        name = f"snapshot_index_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (series, key) SORTED BY (series, key) INTO {buckets} BUCKETS LOCATION '{path}'")
        out = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return out

    def _write(self, df: DataFrame, path: str, moved: bool) -> DataFrame:
        name = f"snapshot_index_{uuid.uuid4().hex}"
        if not moved:
            df = df.repartition(self.buckets, "series", "key")
        df.write.bucketBy(self.buckets, "series", "key").sortBy("series", "key").option("path", path).mode("overwrite").saveAsTable(name)
        out = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return out

    def _next(self) -> tuple[int, str | None, int]:
        """(the version to write, the folder in force, its buckets); what an unfinished run left of the new version goes."""
        seen = self._published()
        version = seen[-1][0] + 1 if seen else 0
        self._fs().delete(self._at(str(version)), True)
        return version, f"{self.path}/{seen[-1][0]}" if seen else None, seen[-1][1] if seen else 0

    def _publish(self, version: int) -> None:
        self._fs().create(self._at(f"{version}-{self.buckets}.current")).close()
        for v, _ in self._published()[:-1]:
            self._fs().delete(self._at(str(v)), True)

    def _advance(self, states: DataFrame, slots: DataFrame) -> tuple[DataFrame, int]:
        """The changes of a delivery, written, and the version whose index is written but not yet in force."""
        c = F.col
        version, force, buckets = self._next()
        rows = self._write(states.select(*[c(n).cast(t) for n, t in (x.split() for x in _STATES.split(", "))]), f"{self.work.root}/{version}-states", False)
        one = W.partitionBy("series", "key").orderBy("i")
        before = F.lag(F.struct("i", "hash")).over(one)
        walked = rows.select("series", "key", "i", "hash", before.alias("b"), F.lead("i").over(one).alias("after"))
        adjacent = c("b.i") == c("i") - 1
        came = F.when(F.coalesce(adjacent, F.lit(False)), F.when(c("b.hash") != c("hash"), "changed")).when(c("i") > 1, "added")
        went = F.when(c("after").isNull() | (c("after") > c("i") + 1), "removed")
        row = lambda i, change: F.struct(i.alias("i"), change.alias("change"))
        changes = walked.select("series", "key", F.inline(F.array(row(c("i"), came), row(c("i") + 1, went)))).where("change is not null")
        entries = rows.where("i = m").select("series", "key", "hash")
        if force:
            index = self._table(f"{force}/index", _ENTRIES, buckets)
            known = self.spark.read.schema("series string").parquet(f"{force}/series")
            first = slots.where("i = 1").join(known, "series", "left_semi").select("series").distinct()
            new = lookup(rows.where("i = 1").select("series", "key", c("hash").alias("_new")), first, "series", written=True)
            old = lookup(index.select("series", "key", c("hash").alias("_old")), first, "series", written=True)
            change = F.when(c("_old").isNull(), "added").when(c("_new").isNull(), "removed").when(c("_new") != c("_old"), "changed")
            probed = new.join(old, ["series", "key"], "full_outer").select("series", "key", F.lit(1).alias("i"), change.alias("change"))
            changes = changes.unionByName(probed.where("change is not null"))
            stays = index.join(slots.select("series").distinct(), "series", "left_anti")
            entries = entries.unionByName(stays)
            series = slots.select("series").union(known).distinct()
        else:
            series = slots.select("series").distinct()
        # a removal after the last snapshot of a series meets no slot and falls away
        found = lookup(changes, slots.select("series", "i", "snapshot"), ["series", "i"])
        out = self.work.cut(found.select("snapshot", "series", "key", "change"), "changes")
        self._write(entries, f"{self.path}/{version}/index", not force)
        series.write.mode("overwrite").parquet(f"{self.path}/{version}/series")
        self.work._fs(self.work.root).delete(self.work._path(f"{self.work.root}/{version}-states"), True)
        return out, version

    def deliver(self, states: DataFrame, slots: DataFrame) -> DataFrame:
        """(snapshot, series, key, change) of a delivery of following snapshots; its last ones become the index.

        `states`: (series, i, m, key, hash), one row per snapshot and key; `slots`: the rows of `numbered`.
        """
        out, version = self._advance(states, slots)
        self._publish(version)
        return out

    def apply(self, rows: DataFrame, record: str, values: Sequence[str]) -> DataFrame:
        """Changes (record, change, old, new) of the one snapshot of a series; the rows become the last snapshot.

        The values lie beside the index, which holds hashes only, and are read for changed keys alone.
        """
        columns = [F.col(v).cast("string") for v in values]
        new = rows.select(
            F.lit("").alias("series"),
            F.col(record).cast("string").alias("key"),
            F.xxhash64(*[x for c in columns for x in (c.isNull(), c)]).alias("hash"),
            F.struct(*[c.alias(v) for c, v in zip(columns, values)]).alias("value"),
        ).where("key is not null")
        new = new.groupBy("series", "key").agg(F.max(F.struct("hash", "value")).alias("_s")).select("series", "key", "_s.*")
        version, force, buckets = self._next()
        shape = new.schema["value"].dataType.simpleString()
        slots = self.spark.range(1).select(F.lit("").alias("series"), F.lit(1).alias("i"), F.lit("").alias("snapshot"))
        kept = self.work.cut(new, "rows")
        found, _ = self._advance(kept.select("series", F.lit(1).alias("i"), F.lit(1).alias("m"), "key", "hash"), slots)
        now = self._write(kept.select("series", "key", "value"), f"{self.path}/{version}/rows", False)
        found = found.select("series", "key", "change")
        if force:
            was = self._table(f"{force}/rows", f"series string, key string, value {shape}", buckets)
            found = found.join(was.withColumnRenamed("value", "old"), ["series", "key"], "left")
        else:
            found = found.withColumn("old", F.lit(None).cast(shape))
        found = found.join(now.withColumnRenamed("value", "new"), ["series", "key"], "left")
        out = self.work.cut(found.select(F.col("key").alias(record), "change", "old", "new"), "values")
        self._publish(version)
        return out

import datetime as dt
import hashlib

from lodestrata.operators.snapshots import SnapshotIndex, finding_changes

F_SCHEMA = "finding_id string, scan_id string, rule_id string, file string, line int, severity string, category string, trend string, payload string, ingested_at timestamp_ntz, extra string, change string"
S_SCHEMA = "scan_id string, scan_timestamp timestamp_ntz, project string"


def t(n):
    return dt.datetime(2032, 1, 1) + dt.timedelta(hours=n)


def f(fid, scan, sev="high", trend="new", payload='{"message":"m"}', at=0, rule="r", file="./a", line=3):
    return (fid, scan, rule, file, line, sev, "sast", trend, payload, t(at), "x", "y")


def changes(spark, findings, scans):
    out = finding_changes(spark.createDataFrame(findings, F_SCHEMA), spark.createDataFrame(scans, S_SCHEMA))
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


SCANS = [("s1", t(0), "P "), ("s2", t(1), "p"), ("s2", t(1), "p"), ("s3", t(2), "p"), ("q1", t(0), "other")]


def test_added_removed_changed(spark):
    rows = [f("A", "s1"), f("b", "s1"), f(" a ", "s2"), f("c", "s2"), f("c", "s2"), f("C", "s3", sev="low"), f("z", "q1"), f("z", None), f("z", "unknown")]
    assert changes(spark, rows, SCANS) == {("s2", "b", "removed"), ("s2", "c", "added"), ("s3", "a", "removed"), ("s3", "c", "changed")}


def test_late_corrections_resolved_and_missing_ids(spark):
    own = hashlib.sha256(b"r:a:3").hexdigest()
    rows = [f(None, "s1"), f("", "s2", at=1), f("k", "s1"), f("k", "s2", trend=" Resolved", at=2), f("k", "s2", at=1), f("k", "s3", at=3)]
    assert changes(spark, rows, SCANS) == {("s2", "k", "removed"), ("s3", "k", "added"), ("s3", own, "removed")}


def test_scan_that_lists_nothing(spark):
    assert changes(spark, [f("a", "s1"), f("a", "s3")], SCANS) == {("s2", "a", "removed"), ("s3", "a", "added")}
    assert changes(spark, [], SCANS) == set()


def test_payload_layout_does_not_matter(spark):
    rows = [f("a", "s1", payload='{"message":"m","effort_mins":5}'), f("a", "s2", payload='{ "effort_mins" : 5, "fix_type": null, "message":"m", "age_days": 9}'), f("a", "s3", payload="no json")]
    assert changes(spark, rows, SCANS) == {("s3", "a", "changed")}


def test_index_swaps_between_deliveries(spark, tmp_path):
    index = SnapshotIndex(spark, f"file://{tmp_path}/ix", buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "k string, v string, n int")
    assert index.apply(frame([("a", "1", 1), ("b", "1", 1), (None, "x", 0)]), "k", ["v", "n"]).collect() == []
    got = {(r.k, r.change, r.old and r.old.v, r.new and r.new.v) for r in index.apply(frame([("a", "2", 1), ("c", "1", None)]), "k", ["v", "n"]).collect()}
    assert got == {("a", "changed", "1", "2"), ("b", "removed", "1", None), ("c", "added", None, "1")}
    assert index.versions() == [0, 1]
    got = {(r.k, r.change) for r in index.apply(frame([]), "k", ["v", "n"]).collect()}
    assert got == {("a", "removed"), ("c", "removed")}

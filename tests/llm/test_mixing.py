import pytest

from lodestrata.llm import mixing

SIZED = "doc_id long, source string, n_tokens long"
TARGETS = "source string, target_share double, max_repeats int"


def run(spark, sizes, targets, budget=None):
    rows, i = [], 0
    for source, lengths in sizes.items():
        for n in lengths:
            rows.append((i, source, n))
            i += 1
    sized = spark.createDataFrame(rows, SIZED)
    mixed, shares, _ = mixing.mix(sized, spark.createDataFrame(targets, TARGETS), budget, sized=sized)
    return mixed.collect(), {r.source: r for r in mixing.shares_reached(mixed, shares).collect()}


def check(rows, targets):
    caps = {s: r for s, _, r in targets}
    assert all(1 <= r.use <= caps[r.source] for r in rows)
    assert len({(r.doc_id, r.use) for r in rows}) == len(rows)
    total = 0
    for r in sorted(rows, key=lambda r: (r.virtual_finish, r.source, r.doc_id, r.use)):
        total += r.n_tokens
        assert r.total_tokens == total


def test_shares_are_reached(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 7)
    targets = [("a", 0.5, 1), ("B ", 0.3, 3), ("c-c", 0.2, 2), ("none", 0.1, 4)]
    rows, shares = run(spark, {"a": [10] * 300, "b": [7] * 60, "c_c": [3] * 400, "unlisted": [5] * 50}, targets)
    check(rows, [("a", 0, 1), ("b", 0, 3), ("c_c", 0, 2)])
    assert shares["none"].used_rows == 0
    for s, want in (("a", 0.5), ("b", 0.3), ("c_c", 0.2)):
        assert shares[s].actual_share == pytest.approx(want, abs=0.01)
    assert {r.use for r in rows if r.source == "b"} == {1, 2, 3}


def test_budget_beyond_supply_uses_everything(spark):
    targets = [("a", 0.5, 1), ("b", 0.5, 2)]
    rows, shares = run(spark, {"a": [10] * 5, "b": [4] * 3}, targets, 10_000)
    check(rows, targets)
    assert (shares["a"].used_tokens, shares["b"].used_tokens) == (50, 24)


def test_exhausted_source_leaves_the_rest_by_weight(spark):
    targets = [("a", 0.25, 1), ("b", 0.25, 1), ("c", 0.5, 1)]
    rows, shares = run(spark, {"a": [1] * 1000, "b": [1] * 1000, "c": [1] * 100}, targets, 500)
    check(rows, targets)
    assert shares["c"].used_tokens == 100 and shares["a"].used_tokens == pytest.approx(200, abs=1)


def test_empty(spark):
    rows, shares = run(spark, {}, [("a", 1.0, 1)])
    assert rows == [] and shares["a"].actual_share == 0.0


def test_sizes_leave_out_empty_texts_and_unknown_sources(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "Hello", " A-b "), (4, "Hello", None), (5, "  ", "a")], "doc_id long, text string, source string")
    assert {(r.doc_id, r.source, r.n_tokens) for r in mixing.sized_documents(docs).collect()} == {(3, "a_b", 1), (5, "a", 2)}


def test_blocks_of_buckets_and_broken_promises(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 5)
    monkeypatch.setattr(mixing, "BUCKETS_PER_BLOCK", 3)
    targets = spark.createDataFrame([("a", 0.7, 1), ("b", 0.3, 4)], TARGETS)
    sized = spark.createDataFrame([(i, "a" if i % 3 else "b", 1 + i % 5) for i in range(400)], SIZED)
    mixed, shares, _ = mixing.mix(sized, targets, sized=sized)
    check(mixed.collect(), [("a", 0, 1), ("b", 0, 4)])
    line = mixing.finish_line(shares, None)[0]
    assert {(r.promise, r.n) for r in mixing.broken_promises(mixed, shares, line).collect()} == {("repeats", 0), ("uses", 0), ("order", 0), ("share", 0)}
    bad = mixed.unionByName(mixed.limit(1)).where("not (source = 'a' and total_tokens > 100)")
    assert {r.promise for r in mixing.broken_promises(bad, shares, line).where("n > 0").collect()} >= {"uses", "order", "share"}


def test_budget_is_met_between_supplies(spark):
    """Water level against a plain search over the sources in order of running out."""
    rows = [("a", 0.5, 100), ("b", 0.3, 900), ("c", 0.2, 50), ("d", 0.0, 70), ("e", 0.4, 0)]
    shares = spark.createDataFrame([(s, w, 1, 1, n, n) for s, w, n in rows], "source string, weight double, repeats int, documents long, tokens long, supply long")
    for budget in (10, 120, 200, 400, 1000, 1050, 5000):
        line, _ = mixing.finish_line(shares, budget)
        given = sum(min(line * w, n) for _, w, n in rows if w and n)
        assert given == pytest.approx(min(budget, 1050))

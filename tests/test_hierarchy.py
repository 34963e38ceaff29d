import random

from pyspark.sql import functions as F

from lodestrata.operators.hierarchy import descendants, hierarchy, paths

EDGE = "child string, parent string, version int"


def brute(rows, nodes=()):
    last = {}
    for child, parent, version in rows:
        if child is not None:
            last[child] = max(last.get(child, (-(10**9), "")), (-(10**9) if version is None else version, parent or ""))
    par = {c: p or None for c, (_, p) in last.items()}
    every = set(par) | {p for _, p, _ in rows if p} | {n for n in nodes if n}
    out = {}
    for n in every:
        way = [n]
        while par.get(way[-1]) and par[way[-1]] not in way:
            way.append(par[way[-1]])
        nxt = par.get(way[-1])
        if nxt:
            out[n] = (min(way[way.index(nxt) :]), -1, [])
        else:
            out[n] = (way[-1], len(way) - 1, way[::-1])
    return out


def run(spark, rows, nodes=(), limit=1 << 20):
    df = spark.createDataFrame(rows, EDGE)
    nd = spark.createDataFrame([(n,) for n in nodes], "node string")
    want = brute(rows, nodes)
    got = {r.node_id: r for r in hierarchy(df, nd, limit).collect()}
    assert {k: (r.root_id, r.depth) for k, r in got.items()} == {k: v[:2] for k, v in want.items()}
    for k, r in got.items():
        below = sum(k in v[2][:-1] for v in want.values())
        assert r.n_descendants == (None if r.depth < 0 else below)
    path_rows = paths(df, nd, limit)
    p = {r.node_id: (r.root_id, r.depth, list(r.path)) for r in path_rows.collect()}
    assert p == want
    pairs = {(r.ancestor_id, r.descendant_id, r.distance) for r in descendants(path_rows).collect()}
    assert pairs == {(a, k, v[1] - i) for k, v in want.items() for i, a in enumerate(v[2][:-1])}


def test_shapes(spark):
    rows = [("b", "a", 1), ("c", "b", 1), ("d", "b", 1), ("x", "y", 1), ("y", "x", 1), ("z", "y", 1), ("w", "z", 1), ("s", "s", 1), ("t", "s", 2), ("e", None, 1)]
    run(spark, rows, ["lonely", None])


def test_latest_row_counts_and_repeats_collapse(spark):
    run(spark, [("a", "b", 1), ("a", "c", 2), ("a", "c", 2), ("d", "a", 1), ("d", None, 5), ("e", "a", None), ("e", "c", 0), (None, "q", 1)])


def test_limit_of_one_element_is_reached(spark):
    run_found = hierarchy(spark.createDataFrame([('b', 'a', 1), ('x', 'x', 1)], EDGE), None, 1)
    assert {(r.node_id, r.depth) for r in run_found.collect()} == {('a', 0), ('b', 1), ('x', -1)}


def test_empty(spark):
    assert hierarchy(spark.createDataFrame([], EDGE)).count() == 0
    assert paths(spark.createDataFrame([], EDGE)).count() == 0


def test_contraction_rounds_long_chain_and_hot_parent(spark):
    """A limit of a few elements makes every round of the distributed ranking run."""
    rng = random.Random(3)
    rows = [(f"c{i}", f"c{i - 1}", 1) for i in range(1, 120)] + [(f"h{i}", "c7", 1) for i in range(80)]
    rows += [(f"n{i}", f"n{rng.randrange(60)}" if rng.random() < 0.9 else None, 1) for i in range(60)]
    run(spark, rows, [f"alone{i}" for i in range(40)], limit=100)


def test_extra_columns_do_not_clash(spark):
    df = spark.createDataFrame([("b", "a", 1)], EDGE).withColumn("node", F.lit("q")).withColumn("face", F.lit(1)).withColumn("row", F.lit(2))
    assert {(r.node_id, r.depth) for r in hierarchy(df).collect()} == {("a", 0), ("b", 1)}


def test_many_partitions(spark):
    """Without coalescing, sibling runs and open intervals cross the borders of partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(f"c{i}", f"c{i - 1}", 1) for i in range(1, 60)] + [(f"h{i}", "c3", 1) for i in range(90)] + [(f"m{i}", f"k{i % 3}", 1) for i in range(30)]
        run(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_tree_of_all_nodes_and_a_parent_of_a_third(spark):
    """Rounds of the distributed ranking at its own limit; the tree and the parent are more than a task's share."""
    rows = [(f"h{i}", "r", 1) for i in range(1000)] + [(f"c{i}", f"c{i - 1}" if i else "h7", 1) for i in range(900)] + [(f"l{i}", f"l{(i + 1) % 700}", 1) for i in range(700)]
    rows += [(f"b{i}", f"l{i % 5}", 1) for i in range(600)]
    want = {k: v[:2] for k, v in brute(rows).items()}
    got = {r.node_id: (r.root_id, r.depth) for r in hierarchy(spark.createDataFrame(rows, EDGE)).collect()}
    assert got == want

import random

from pyspark.sql import functions as F

from lodestrata.operators import inventory as op

OCC = "id string, name string, selected_version string, root string, extra int"


def test_nearest_ancestor(spark):
    entries = spark.createDataFrame([("node_modules/a",), ("node_modules/b/node_modules/a",), ("p/node_modules/c",)], "entry string")
    ask = [("node_modules/b", "a"), ("node_modules/b/node_modules/x", "a"), ("node_modules/z", "a"), ("", "a"), ("p/q", "c"), ("q", "c"), ("node_modules/b", "a")]
    got = {(r.path, r.name): r.entry for r in op.nearest_ancestor(spark.createDataFrame(ask, "path string, name string"), entries).collect()}
    inner = "node_modules/b/node_modules/a"
    assert got == {("node_modules/b", "a"): inner, ("node_modules/b/node_modules/x", "a"): inner, ("node_modules/z", "a"): "node_modules/a", ("", "a"): "node_modules/a", ("p/q", "c"): "p/node_modules/c", ("q", "c"): None}


def test_unique_match(spark):
    s = spark.createDataFrame([(1, "a", "1"), (2, "a", "9"), (3, "b", "1"), (4, None, "1")], "s int, name string, want string")
    c = spark.createDataFrame([("x", "a", "1"), ("y", "a", "2"), ("z", "b", "1"), ("w", "b", "1")], "c string, name string, has string")
    got = {r.s: (r.c, r.matches) for r in op.unique_match(s, c, ["name"], F.col("want") == F.col("has"), "s", "c").collect()}
    assert got == {1: ("x", 1), 2: (None, 0), 3: (None, 2), 4: (None, 0)}


def test_reachability_and_contexts(spark):
    o = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "parent_id string, child_id string")
    assert {r.id: r.directness for r in op.reachability(o, e).collect()} == {"a": "unknown", "b": "direct", "c": "direct", "d": "unknown"}
    loop = spark.createDataFrame([("x", "y"), ("y", "x"), ("r", "s")], "parent_id string, child_id string")


def _walked(ids, edges):
    named = {c for _, c in edges}
    direct = {c for p, c in edges if p not in named}
    seen, front = set(direct), list(direct)
    while front:
        at = front.pop()
        for c in {c for p, c in edges if p == at} - seen:
            seen.add(c)
            front.append(c)
    return {i: "direct" if i in direct else "transitive" if i in seen else "unknown" for i in ids}


def test_reachability_is_a_walk_from_the_roots(spark):
    # r leads into the loop b-c, nothing into x-y, on which z and w hang; s is its own parent; d is met from a loop and from r's side
    edges = [("r", "a"), ("a", "b"), ("b", "c"), ("c", "b"), ("x", "y"), ("y", "x"), ("y", "z"), ("z", "w"), ("s", "s"), ("s", "t"), ("w", "d"), ("c", "d"), ("d", "e"), ("r", "f"), ("w", "f")]
    want = dict.fromkeys("af", "direct") | dict.fromkeys("bcde", "transitive") | dict.fromkeys("rxyzwstq", "unknown")
    assert _walked(want, edges) == want
    rng = random.Random(5)
    for g, (n, m) in enumerate(((40, 30), (40, 45), (60, 80))):
        edges += [(f"{g}-{rng.randrange(n)}", f"{g}-{rng.randrange(n)}") for _ in range(m)]
    edges += [(f"k{i}", f"k{i + 1}") for i in range(69)]
    ids = sorted({*want, *(x for e in edges for x in e)})
    o, e = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(edges, "parent_id string, child_id string")
    assert {r.id: r.directness for r in op.reachability(o, e).collect()} == _walked(ids, edges)
    assert [r.directness for r in op.reachability(o.limit(1), e.limit(0)).collect()] == ["unknown"]


def test_ranks_equal_a_sort(spark):
    rng = random.Random(2)
    rows = [(f"i{i:03}", rng.choice(["hot", "hot", "a", "b", None]), rng.choice(["1", "2", None]), rng.choice(["r", "r", "q"]), 0) for i in range(400)]
    want = {}
    for root in "rq":
        own = sorted((n or "", v is None, v or "", i) for i, n, v, r, _ in rows if r == root)
        want |= {i: k for k, (*_, i) in enumerate(own)}
    assert {r.id: r.name_version_rank for r in op.ranked(spark.createDataFrame(rows, OCC), "root").collect()} == want
    assert op.ranked(spark.createDataFrame([], OCC), "root").count() == 0


def test_license_states(spark):
    o = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    obs = spark.createDataFrame([("a", "MIT"), ("a", "MIT"), ("b", "MIT"), ("b", "X"), ("c", None), ("c", "MIT")], "occurrence_id string, expression string")
    assert {r.id: (r.state, r.expression) for r in op.license_states(o, obs).collect()} == {"a": ("stated", "MIT"), "b": ("conflicting", None), "c": ("unparsed", None), "d": ("unstated", None)}
    assert [r.id for r in op.license_gaps(o, obs).collect()] == ["d"]


def test_digests_do_not_depend_on_order_or_partitions(spark):
    rows = [(f"i{i}", "n", None if i % 3 else "1", "r" if i % 2 else "q", 0) for i in range(50)]
    digest = lambda df: {r.root: (r.n, r.digest) for r in op.row_digest(df, ["id"], ["name", "selected_version"], "root").collect()}
    a, b = spark.createDataFrame(rows, OCC), spark.createDataFrame(rows[::-1], OCC).repartition(7)
    assert digest(a) == digest(b) != digest(spark.createDataFrame(rows[:-1], OCC))


def test_overlaps_bindings_coverage_and_ranges(spark):
    v = spark.createDataFrame([("a", "x", 1, 3), ("a", "y", 2, 5), ("a", "z", 6, 7), ("b", "x", 1, 9)], "name string, variant string, low int, high int")
    assert [tuple(r) for r in op.overlaps(v, "name", "variant", "low", "high").collect()] == [("a", "x", "y")]
    m = spark.createDataFrame([(0, "a", "n"), (1, "a", "other"), (2, "?", "n"), (3, "b", None)], "ordinal int, occurrence_id string, name string")
    o = spark.createDataFrame([("a", "n"), ("b", None)], "id string, name string")
    assert sorted((r.ordinal, r.problem) for r in op.bound_matches(m, o, ["name"]).collect()) == [(0, None), (1, "contradicts-occurrence"), (2, "unknown-occurrence"), (3, None)]
    c = spark.createDataFrame([("a", "parsed"), ("a", "failed"), ("b", "parsed"), ("c", "failed")], "k string, disposition string")
    assert {r.k: r.fidelity for r in op.coverage(c, "k").collect()} == {"a": "partial", "b": "complete", "c": "failed"}
    e = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1"), ("b", "2")], "child string, declared_range string")
    assert [tuple(r) for r in op.unique_range(e).collect()] == [("a", "1")]


def test_constraints_meet_requirements_unless_disjoint(spark):
    r = spark.createDataFrame([(1, "a", None), (2, "a", "python_version < '3.8'"), (3, "b", None)], "id int, name string, marker string")
    c = spark.createDataFrame([(9, "a", "python_version >= '3.8'")], "id int, name string, marker string")
    assert [tuple(x) for x in op.constraint_links(r, c).collect()] == [(1, 9)]


def _contexts(files, edges):
    """Brute force: every way from every file that doesn't turn back."""
    out = set()

    def walk(origin, path, role, way):
        out.add((origin, path, role))
        for p, t, kind in edges:
            if p == path and t is not None and t not in way:
                walk(origin, t, "constraint" if "constraint" in (role, kind) else "requirement", [*way, t])

    for f in files:
        walk(f, f, "constraint" if f.startswith("constraints") else "requirement", [f])
    return out


def test_include_contexts_keep_every_origin_and_role(spark):
    files = ["a.txt", "b.txt", "c.txt", "d.txt", "constraints.txt", "x.txt", "y.txt"]
    edges = [("a.txt", "c.txt", "requirement"), ("b.txt", "c.txt", "requirement"), ("b.txt", "c.txt", "constraint"), ("c.txt", "d.txt", "requirement"),
             ("constraints.txt", "d.txt", "requirement"), ("x.txt", "y.txt", "requirement"), ("y.txt", "x.txt", "constraint"), ("a.txt", None, "requirement"), ("d.txt", "gone.txt", "requirement")]
    f, e = spark.createDataFrame([(x,) for x in [*files, "a.txt"]], "path string"), spark.createDataFrame([*edges, edges[0]], "path string, target string, kind string")
    got, cut = op.include_contexts(f, e)
    rows = [(r.origin, r.path, r.role) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == _contexts(files, edges) and cut.count() == 0
    got, cut = op.include_contexts(f, e, 1)
    assert ("a.txt", "c.txt", "d.txt") in {tuple(r) for r in cut.collect()}
    assert {r.hops for r in got.collect()} == {0, 1}
    assert op.include_contexts(f.limit(0), e)[0].count() == 0


def test_unique_by_key(spark):
    s = spark.createDataFrame([(f"s{i}", "hot", "1") for i in range(50)] + [("t", "a", "1"), ("u", "b", "9"), ("v", None, "1")], "selector string, name string, version string")
    c = spark.createDataFrame([("c1", "hot", "1"), ("c2", "a", "1"), ("c3", "a", "1"), ("c4", None, "1")], "candidate string, name string, version string")
    got = {r.selector: (r.candidate, r.matches) for r in op.unique_by_key(s, c, ["name", "version"], "selector", "candidate").collect()}
    assert got == {**{f"s{i}": ("c1", 1) for i in range(50)}, "t": (None, 2), "u": (None, 0), "v": (None, 0)}

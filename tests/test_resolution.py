from lodestrata.operators import resolution as op
from lodestrata.plans import inventory as plans
from lodestrata.sources import config, files


def test_selection(spark):
    rows = [("p", "a", "==1.0"), ("p", "a", ">=0.9"), ("p", "a", ">=0.9"), ("p", "b", "==1"), ("p", "b", "==2"), ("p", "c", ">1"), ("p", "d", None), ("p", "e", "??"), ("p", "f", "==1"), ("p", "f", "<1"), (None, "g", "==1"), ("q", "a", "==1"), ("q", "a", "==1.0")]
    got = {(r.project, r.name): (r.version, r.reason) for r in op.selected_versions(spark.createDataFrame(rows, "project string, name string, range string")).collect()}
    assert got == {("p", "a"): ("1.0", "selected"), ("p", "b"): (None, "conflict"), ("p", "c"): (None, "open"), ("p", "d"): (None, "open"), ("p", "e"): (None, "invalid"), ("p", "f"): (None, "conflict"), ("q", "a"): (got["q", "a"][0], "selected")}
    assert op.selected_versions(spark.createDataFrame([], "project string, name string, range string")).count() == 0


def test_selection_query_checks_every_range(spark, tmp_path):
    import datetime as dt
    import random

    want = {
        ("pypi", "in"): ([("locked", "1.4.0", "^1.2"), ("declared", "9.9", "~1.4.0")], ("1.4.0", "selected")),
        ("pypi", "out"): ([("locked", "2.0.0", "^1.2")], (None, "conflict")),
        ("pypi", "other"): ([("locked", "1.0", ">=1"), ("declared", None, "~1.1")], (None, "conflict")),
        ("pypi", "bad"): ([("locked", "1.0", "?!")], (None, "invalid")),
        ("pypi", "loose"): ([("declared", "1.0", "^1.0")], (None, "open")),
        ("pypi", "exact"): ([("declared", "3", "==1.5"), ("declared", None, "^1.2")], ("1.5", "selected")),
        ("pypi", "bare"): ([("locked", "1.5", None), ("declared", None, "<1.5 || >2")], (None, "conflict")),
        ("npm", "in"): ([("locked", "0.2.9", "^0.2.3")], ("0.2.9", "selected")),
        ("npm", "out"): ([("locked", "0.3.0", "^0.2.3")], (None, "conflict")),
        ("npm", "exact"): ([("declared", None, "1.2.3"), ("imported", None, "~1.2.0")], ("1.2.3", "selected")),
        ("npm", "bad"): ([("locked", "1.x", "^1.0.0")], (None, "invalid")),
        ("cargo", "bare"): ([("locked", "1.9.0", "1.2.3"), ("declared", None, ">=1.0, <2.0")], ("1.9.0", "selected")),
        ("cargo", "open"): ([("declared", None, "1.2.3")], (None, "open")),
        ("nuget", "span"): ([("locked", "2.5", "[1.0, 3.0)"), ("declared", None, "2.0")], ("2.5", "selected")),
        ("nuget", "only"): ([("declared", None, "[2.5]"), ("declared", None, "(2.5,)")], (None, "conflict")),
        ("nuget", "caret"): ([("locked", "2.5", "^2.0")], (None, "invalid")),
    }
    rng = random.Random(3)
    top = {"^": lambda v: (v[0] + 1, 0, 0) if v[0] else (0, v[1] + 1, 0) if v[1] else (0, 0, v[2] + 1), "~": lambda v: (v[0], v[1] + 1, 0), ">=": lambda v: (99, 0, 0)}
    text = lambda v: ".".join(map(str, v))
    for k in range(60):
        pin, asked = tuple(rng.randrange(3) for _ in range(3)), [(rng.choice(["^", "~", ">="]), tuple(rng.randrange(3) for _ in range(3))) for _ in range(rng.choice([1, 1, 2]))]
        fits = all(v <= pin < top[o](v) for o, v in asked)
        want[rng.choice(["pypi", "npm", "cargo"]), f"r{k}"] = ([("locked", text(pin), o + text(v)) for o, v in asked], (text(pin), "selected") if fits else (None, "conflict"))
    rows = [(f"{e}/{n}/{i}", e, n, *x, dt.datetime(2031, 1, 1)) for (e, n), (given, _) in want.items() for i, x in enumerate(given)]
    schema = "id string, ecosystem string, name string, evidence_kind string, selected_version string, declared_range string, recorded_at timestamp_ntz"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/occurrences.parquet")
    got = {(r.project, r.name): (r.version, r.reason) for r in plans.selected_versions(spark, str(tmp_path)).collect()}
    assert got == {k: v for k, (_, v) in want.items()}


def test_origins(spark):
    rows = [("p", "a", "b"), ("p", "b", "a"), ("p", "b", "c"), ("p", "c", "d"), ("p", "d", "c"), ("p", "x", "c"), ("p", "x", "c"), ("p", None, "c"), ("q", "s", "s")]
    got = {(r.project, r.node): (r.component, r.is_origin) for r in op.include_origins(spark.createDataFrame(rows, "project string, parent string, child string")).collect()}
    assert got == {("p", "a"): ("a", True), ("p", "b"): ("a", True), ("p", "c"): ("c", False), ("p", "d"): ("c", False), ("p", "x"): ("x", True), ("q", "s"): ("s", True)}
    deep = [("p", f"n{i:05}", f"n{i + 1:05}") for i in range(3000)]
    assert op.include_origins(spark.createDataFrame(deep, "project string, parent string, child string")).where("is_origin").count() == 1


def test_lock_roots(spark):
    schema = "path string, name string, range string, scope string"
    m = spark.createDataFrame([("x", "a", "1", "r"), ("x", "b", None, "r"), ("y", "a", "1", "r")], schema)
    k = spark.createDataFrame([("x", "b", None, "r"), ("x", "a", "1", "r"), ("y", "a", "2", "r"), ("z", "a", "1", "r")], schema)
    assert {r.path: r.agrees for r in op.lock_roots(m, k).collect()} == {"x": True, "y": False, "z": False}


def test_files(spark, tmp_path):
    for p, text in (("a/go.mod", "module m"), (".git/config", "x"), ("b/.hg/y", "x"), ("c.txt", "a"), ("empty.txt", "")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text)
    found = {r.path: (r.size, r.format, r.ecosystem) for r in files.discover(spark, f"file://{tmp_path}").collect()}
    assert found == {"a/go.mod": (8, "go-mod", "golang"), "c.txt": (1, "pip-requirements", "pypi")}
    a, b = (spark.createDataFrame(x, "path string, sha256 string") for x in ([("a", "1"), ("b", "1"), ("c", "1")], [("a", "1"), ("b", "2"), ("d", "1")]))
    assert sorted(tuple(r) for r in files.altered(a, b).collect()) == [("b", "changed"), ("c", "removed"), ("d", "added")]
    paths = ["a/b", "/a", "../a", "a//b", "", None, "a\\b", "x" * 256, "./a", "/stage/a/./b", "/stage/a"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string")
    rows = df.select("i", files.admissible_path(df.p).alias("ok"), files.repository_path(df.p, "/stage").alias("r")).orderBy("i").collect()
    assert [r.ok for r in rows] == [True] + [False] * 10
    assert [r.r for r in rows] == ["a/b", None, None, None, None, None, None, None, "a", None, "a"]


def test_configuration(spark):
    data = config.load("ignore:\n- {rule_id: r, permanent: true, reason: x}\n- {until: 2031-01-01}\n- {message: m, until: soon, reason: ' '}\npolicy:\n- {severity: high, max_count: 0, action: fail}\n- {severity: odd, category: CVE, max_count: x}\n- {category: nope, action: stop, max_count: -1}\n")
    ignored, policy = config.frames(spark, data)
    assert sorted((r.ord, r.problem) for r in config.ignore_problems(ignored).collect()) == [(1, "no-matcher"), (1, "no-reason"), (2, "bad-date"), (2, "no-reason")]
    assert sorted((r.ord, r.problem) for r in config.policy_problems(policy).collect()) == [(1, "bad-limit"), (1, "bad-severity"), (1, "no-action"), (2, "bad-action"), (2, "bad-category"), (2, "bad-limit")]
    assert config.ignore_rules(data)[1].until == "2031-01-01" and config.load("") == {}


def test_projection_is_keyed_once(spark):
    o = spark.createDataFrame([("a", "npm", "n", "1", "locked", "direct", ["x", "x", None])], "id string, ecosystem string, name string, selected_version string, evidence_kind string, directness string, scopes array<string>")
    e = spark.createDataFrame([("a", "b", "evidenced")], "parent_id string, child_id string, evidence_status string")
    v = spark.createDataFrame([("a", None), ("a", None)], "occurrence_id string, expression string")
    got = sorted((r.table, r.key) for r in op.projected_rows(o, e, v).collect())
    assert got == [("evidence", "a|"), ("occurrence", "a"), ("occurrence_facet", "a|scope|x"), ("relationship", "a|b")]

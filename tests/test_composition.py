import json

from lodestrata.operators.composition import composed
from lodestrata.sources.packages import read_packages

NPM = {"lockfileVersion": 3, "packages": {
    "": {"dependencies": {"a": "^1.0.0", "gone": "1"}, "devDependencies": {"p": "*"}},
    "node_modules/a": {"version": "1.2.0", "dependencies": {"b": "~2.0.0", "c": "^9.0.0"}, "peerDependencies": {"q": "*"}},
    "node_modules/a/node_modules/b": {"version": "2.0.1", "dependencies": {"c": "^1.0.0"}},
    "node_modules/b": {"version": "3.0.0"}, "node_modules/c": {"version": "1.1.1"}, "node_modules/p": {"version": "not a version"},
    "node_modules/loop1": {"version": "1.0.0", "dependencies": {"loop2": "*"}}, "node_modules/loop2": {"version": "1.0.0", "dependencies": {"loop1": "*"}},
}}
CARGO = """
[[package]]
name = "app"
version = "0.1.0"
dependencies = ["dup 1.0.0", "only", "twice", "app"]
[[package]]
name = "dup"
version = "1.0.0"
source = "registry+https://x.example/i"
dependencies = ["only", "twice 2.0.0", "app", "none"]
[[package]]
name = "only"
version = "1.0.0"
source = "registry+https://x.example/i"
[[package]]
name = "twice"
version = "1.0.0"
source = "registry+https://x.example/i"
dependencies = ["twice"]
[[package]]
name = "twice"
version = "2.0.0"
source = "registry+https://x.example/i"
"""
NUGET = {"dependencies": {"net8.0": {"A": {"type": "Direct", "requested": "[1.0.0, )", "resolved": "1.0.0", "dependencies": {"B": "1.0.0", "C": "3.0.0", "D": "1.0.0", "E": "^1"}},
                                     "B": {"type": "Transitive", "resolved": "1.1.0"}, "C": {"type": "Transitive", "resolved": "2.0.0"}, "E": {"type": "Transitive", "resolved": "1.0.0"}}, "net9.0": {"D": {"type": "Direct", "resolved": "1.0.0"}}}}
POETRY = """
[[package]]
name = "a"
version = "1.0"
[package.dependencies]
b = ">=2"
c = "*"
d = ">=9"
[[package]]
name = "b"
version = "1.0"
[[package]]
name = "b"
version = "2.0"
[[package]]
name = "c"
version = "1.0"
[[package]]
name = "c"
version = "2.0"
[[package]]
name = "d"
version = "1.0"
"""
YARN = '"a@^1.0.0", "a@~1.1.0":\n  version "1.1.2"\n  dependencies:\n    b "^2.0.0"\n    c "^1.0.0"\n\nb@^2.0.0:\n  version "2.3.0"\n\nc@^1.0.0:\n  version "2.0.0"\n'
PNPM = "lockfileVersion: '9.0'\nimporters:\n  .:\n    dependencies:\n      a: {specifier: ^1.0.0, version: 1.1.0}\npackages:\n  a@1.1.0: {resolution: {}}\n  b@2.0.0: {resolution: {}}\n  z@1.0.0: {resolution: {}}\nsnapshots:\n  a@1.1.0:\n    dependencies: {b: 2.0.0, x: 1.0.0}\n"
GO = "module m\nrequire (\n\texample.org/a v1.0.0\n\texample.org/b v1.2.0 // indirect\n)\nreplace example.org/a => ../a\n"
FILES = [("n/package-lock.json", json.dumps(NPM)), ("c/Cargo.lock", CARGO), ("u/packages.lock.json", json.dumps(NUGET)), ("p/poetry.lock", POETRY), ("y/yarn.lock", YARN),
         ("q/pnpm-lock.yaml", PNPM), ("g/go.mod", GO), ("bad/package-lock.json", "{"), ("r/README.md", "x")]


def compose(spark, files=FILES):
    return composed(read_packages(spark.createDataFrame([*files, *files[:1]] if files else [], "path string, content string").dropDuplicates(["path"])))


def test_every_format_is_composed(spark):
    out = compose(spark)
    said = {(r.path[0], r.parent_locator, r.name): (r.disposition, r.reason, r.child_locator) for r in out.selectors.collect()}
    yes = "unique-source-endpoint"
    assert said["n", None, "a"] == ("resolved", yes, "node_modules/a") and said["n", None, "gone"][1] == "npm-source-endpoint-not-admitted"
    assert said["n", None, "p"][1] == "npm-source-endpoint-not-admitted"
    assert said["n", "node_modules/a", "b"] == ("resolved", yes, "node_modules/a/node_modules/b")
    assert said["n", "node_modules/a", "c"] == ("unresolved", "npm-selector-version-mismatch", None)
    assert said["n", "node_modules/a", "q"] == ("unresolved", "npm-peer-context-unassessed", None)
    assert said["n", "node_modules/a/node_modules/b", "c"] == ("resolved", yes, "node_modules/c")
    assert said["c", "/package/1", "only"] == ("resolved", yes, "/package/2") and said["c", "/package/1", "twice"] == ("resolved", yes, "/package/4")
    assert said["c", "/package/3", "twice"][1] == "ambiguous-cargo-lock-selector"
    assert said["c", "/package/1", "app"][1] == said["c", "/package/1", "none"][1] == "cargo-source-endpoint-not-admitted"
    a = "/dependencies/net8.0/A"
    assert [said["u", a, x][1] for x in "bcde"] == ["source-nuget-lock-endpoint", "contradictory-nuget-dependency-range", "missing-nuget-lock-endpoint", "unassessed-nuget-dependency-range"]
    assert said["p", "/package/0", "b"] == ("resolved", "unambiguous-lock-selection", "/package/2")
    assert [said["p", "/package/0", x][1] for x in "cd"] == ["ambiguous-lock-dependency", "missing-lock-dependency"]
    assert said["y", "line:1", "b"][:2] == ("resolved", yes) and said["y", "line:1", "c"][1] == "yarn-selector-version-mismatch"
    assert said["q", "/packages/a@1.1.0", "b"] == ("resolved", yes, "/packages/b@2.0.0") and said["q", "/packages/a@1.1.0", "x"][1] == "pnpm-source-endpoint-not-admitted"


def test_directness_coverage_and_losses(spark):
    out = compose(spark)
    how = {(r.path[0], r.locator): r.directness for r in out.occurrences.collect()}
    assert {k[1].split("node_modules/", 1)[1]: v for k, v in how.items() if k[0] == "n"} == {
        "a": "direct", "a/node_modules/b": "transitive", "b": "unknown", "c": "transitive", "loop1": "unknown", "loop2": "unknown"}
    assert {k[1]: v for k, v in how.items() if k[0] == "q"} == {"/packages/a@1.1.0": "direct", "/packages/b@2.0.0": "transitive", "/packages/z@1.0.0": "unknown"}
    assert sorted(v for k, v in how.items() if k[0] == "u") == ["direct", "direct", "transitive", "transitive", "transitive"]
    assert {v for k, v in how.items() if k[0] in "cpyg"} == {"unknown"} and ("c", "/package/0") not in how
    asked = {r.locator: r.declared_range for r in out.occurrences.where("path like 'n/%'").collect()}
    assert asked["node_modules/a"] == "^1.0.0" and asked["node_modules/c"] is None
    cover = {r.path: (r.disposition, r.fidelity) for r in out.coverage.collect()}
    assert cover["bad/package-lock.json"] == ("failed", "failed") and cover["r/README.md"][1] == "unknown" and cover["g/go.mod"] == ("parsed", "complete") and cover["n/package-lock.json"] == ("parsed", "partial")
    assert sorted((r.dimension, r.reason) for r in out.losses.collect()) == [("graph", "unassessed-go-indirect-annotation"), ("version", "unassessed-replace-directive")]
    kept = {(r.path[0], r.parent_locator, r.child_locator) for r in out.relationships.collect()}
    assert ("n", "node_modules/a", "node_modules/a/node_modules/b") in kept and all(p for _, p, _ in kept)
    assert {r.name for r in out.declarations.where("path like 'g/%'").collect()} == {"example.org/a", "example.org/b"}


def test_nothing_to_compose(spark):
    out = compose(spark, [])
    assert all(x.count() == 0 for x in (out.occurrences, out.selectors, out.relationships, out.coverage, out.losses))

import base64
import hashlib
import json

import pytest

from lodestrata.sources import packages as P

S512 = "sha512-" + base64.b64encode(hashlib.sha512(b"x").digest()).decode()


def rows(path, content):
    about, *out = P.parse(path, content)
    return about["status"], about["reason"], out


def brief(out, kind):
    return [(r["name"], r.get("version"), r.get("range"), tuple(r.get("scopes") or ()), r.get("parent")) for r in out if r["kind"] == kind]


def test_requirements():
    status, _, out = rows("a/requirements-dev.txt", "# c\nDjango_X==1.2 \\\n  --hash=sha256:ab ; python_version > '3'\n-r base.txt\n-c cons.txt\nb[x,y]>=1,<2 # t\n--index-url https://x\n")
    assert status == "parsed"
    assert brief(out, "include") == [("base.txt", None, None, ("requirement",), None), ("cons.txt", None, None, ("constraint",), None)]
    d = [r for r in out if r["kind"] == "declaration"]
    assert (d[0]["name"], d[0]["version"], d[0]["hashes"], d[0]["locator"]) == ("django-x", "1.2", ["sha256:ab"], "line:2")
    assert (d[1]["range"], d[1]["extras"]) == ("<2,>=1", ["x", "y"])
    assert rows("x.txt", "???")[:2] == ("failed", "invalid-requirement") and rows("x.in", "-e .")[0] == "unsupported"


def test_python_manifests_and_locks():
    out = rows("pyproject.toml", '[project]\ndependencies=["a>=1"]\n[project.optional-dependencies]\nt=["b"]\n[build-system]\nrequires=["c"]\n[tool.poetry.dependencies]\npython="^3"\nd="^1.0"\n')[2]
    assert brief(out, "declaration") == [("a", None, ">=1", ("runtime",), None), ("b", None, None, ("extra:t",), None), ("c", None, None, ("build",), None), ("d", None, "^1.0", ("runtime",), None)]
    assert rows("pyproject.toml", '[project]\ndynamic=["dependencies"]')[0] == "unsupported"
    assert brief(rows("setup.cfg", "[options]\ninstall_requires =\n  a==1\n")[2], "declaration") == [("a", "1", "==1", ("runtime",), None)]
    assert brief(rows("setup.py", "from setuptools import setup\nsetup(install_requires=['a'], extras_require={'t': ['b']})")[2], "declaration") == [("a", None, None, ("runtime",), None), ("b", None, None, ("extra:t",), None)]
    assert rows("setup.py", "setup(install_requires=open('x').read())")[0] == "unsupported"
    assert brief(rows("Pipfile.lock", json.dumps({"default": {"A": {"version": "==1"}}, "develop": {"b": {"version": "==2"}}}))[2], "package") == [("a", "1", None, ("runtime",), None), ("b", "2", None, ("development",), None)]
    lock = '[[package]]\nname="a"\nversion="1"\n[package.dependencies]\nb=">=2"\n[[package]]\nname="b"\nversion="2"\n'
    out = rows("poetry.lock", lock)[2]
    assert [r[:2] for r in brief(out, "package")] == [("a", "1"), ("b", "2")] and brief(out, "edge") == [("b", None, ">=2", (), "a")]
    out = rows("uv.lock", '[[package]]\nname="a"\nversion="1"\ndependencies=[{name="b", marker="os_name==\'nt\'"}]\n')[2]
    assert [(r["name"], r["marker"]) for r in out if r["kind"] == "edge"] == [("b", "os_name=='nt'")]
    out = rows("x.dist-info/METADATA", "Name: A.b\nVersion: 1\nLicense-Expression: MIT\nRequires-Dist: c>=1; extra == 't'\n")[2]
    assert (out[0]["name"], out[0]["license"]) == ("a-b", "MIT") and out[1]["marker"] == 'extra == "t"'


def test_javascript():
    out = rows("package.json", json.dumps({"name": "r", "dependencies": {"a": "1", "o": "2"}, "optionalDependencies": {"o": "3"}, "devDependencies": {"d": "*"}}))[2]
    assert brief(out, "declaration") == [("a", None, "1", ("runtime",), None), ("d", None, "*", ("development",), None), ("o", None, "3", ("optional",), None)]
    lock = {"lockfileVersion": 3, "packages": {"": {"dependencies": {"a": "^1"}}, "node_modules/a": {"version": "1.0.0", "integrity": S512, "devOptional": True, "resolved": "https://r/a", "license": "MIT", "dependencies": {"b": "1"}}, "node_modules/a/node_modules/b": {"version": "1.1.0", "extraneous": True}}}
    out = rows("x/package-lock.json", json.dumps(lock))[2]
    assert brief(out, "package") == [("a", "1.0.0", None, ("development", "optional"), None), ("b", "1.1.0", None, ("unknown",), None)]
    assert out[1]["hashes"] == ["sha512:" + hashlib.sha512(b"x").hexdigest()]
    assert brief(out, "edge") == [("a", None, "^1", ("dependencies",), ""), ("b", None, "1", ("dependencies",), "node_modules/a")]
    assert rows("package-lock.json", '{"lockfileVersion": 1}')[0] == "unsupported" and rows("package-lock.json", '{"a":1,"a":2}')[1] == "duplicate-key"
    out = rows("pnpm-lock.yaml", "importers:\n  .:\n    dependencies:\n      a: {specifier: ^1, version: 1.0.0(p@1)}\npackages:\n  a@1.0.0: {resolution: {integrity: x}}\nsnapshots:\n  a@1.0.0:\n    dependencies: {b: 2.0.0}\n")[2]
    assert brief(out, "edge") == [("a", "1.0.0", "^1", ("runtime",), "."), ("b", "2.0.0", None, (), "a@1.0.0")] and brief(out, "package")[0][:2] == ("a", "1.0.0")
    out = rows("yarn.lock", '# yarn lockfile v1\n\n"@s/a@^1", "@s/a@~1.0":\n  version "1.0.0"\n  resolved "https://r/a#h"\n  dependencies:\n    b "^2"\n\nb@^2:\n  version "2.1.0"\n')[2]
    assert brief(out, "edge") == [("b", None, "^2", ("dependencies",), "@s/a@^1")] and [r[:2] for r in brief(out, "package")] == [("@s/a", "1.0.0"), ("b", "2.1.0")]


def test_other_ecosystems():
    out = rows("Cargo.lock", '[[package]]\nname="a"\nversion="1.0.0"\nsource="registry+https://r"\nchecksum="ab"\ndependencies=["b", "c 2.0.0"]\n')[2]
    assert brief(out, "edge") == [("b", None, None, (), "a 1.0.0"), ("c", "2.0.0", None, (), "a 1.0.0")]
    assert brief(rows("Cargo.toml", '[package]\nname="r"\nversion="1.0.0"\n[dependencies]\na="1"\nz={package="b",version="2"}\n')[2], "declaration") == [("a", None, "1", ("runtime",), None), ("b", None, "2", ("runtime",), None)]
    out = rows("go.mod", "module x.y/z\ngo 1.2\nrequire (\n a.b/c v1.0.0\n d.e/f v2.0.0 // indirect\n)\nreplace a => b\n")[2]
    assert brief(out, "declaration") == [("a.b/c", None, "v1.0.0", ("direct",), None), ("d.e/f", None, "v2.0.0", ("indirect",), None)]
    assert brief(rows("gradle.lockfile", "# c\ng:a:1.0=runtime,compile\nempty=test\n")[2], "package") == [("g/a", "1.0", None, ("compile", "runtime"), None)]
    for text, reason in (("g:a:1=x\n", "missing-gradle-empty-marker"), ("g:a:1=x\ng:a:2=x\nempty=\n", "contradictory-gradle-locked-version"), ("g:a:1=x\nempty=x\n", "contradictory-gradle-empty-configuration"), ("empty=\ng:a:1=x\n", "text-after-empty-marker")):
        assert rows("gradle.lockfile", text)[1] == reason
    out = rows("packages.lock.json", json.dumps({"dependencies": {"net8": {"A.B": {"type": "Direct", "requested": "[1, )", "resolved": "1.2.0", "dependencies": {"C": "1"}}}}}))[2]
    assert brief(out, "package") == [("a.b", "1.2.0", "[1, )", ("net8",), None)] and brief(out, "edge") == [("c", None, "1", ("net8",), "a.b")]
    out = rows("composer.lock", json.dumps({"packages": [{"name": "a/b", "version": "v1.0", "license": ["MIT", "GPL-2.0-only AND X"]}], "packages-dev": []}))[2]
    assert (out[0]["version"], out[0]["license"]) == ("1.0", "MIT OR (GPL-2.0-only AND X)")
    out = rows("Gemfile.lock", "GEM\n  remote: https://r/\n  specs:\n    a (1.0)\n      b (>= 1)\n\nPLATFORMS\n  ruby\n\nDEPENDENCIES\n  a (~> 1)\n")[2]
    assert brief(out, "package")[0][:2] == ("a", "1.0") and brief(out, "declaration")[0][:3] == ("a", None, "~> 1") and brief(out, "loss")[0][0] == "b"


@pytest.mark.parametrize("path", ["package.json", "Cargo.lock", "gradle.lockfile", "Gemfile.lock", "pyproject.toml", "uv.lock", "yarn.lock", "go.mod", "composer.lock", "pnpm-lock.yaml", "Pipfile.lock", "packages.lock.json"])
@pytest.mark.parametrize("content", [None, "", "\x00", "[]", "{", b"\xff\xfe", '{"dependencies": 3, "packages": [1]}', "[[package]]\n"])
def test_broken_files_never_raise(path, content):
    assert P.parse(path, content)[0]["status"] in ("parsed", "failed", "unsupported")


def test_over_a_table(spark):
    df = spark.createDataFrame([("a/go.mod", "module m\n", "q"), ("b/readme.md", "x", "q"), ("c/go.mod", None, "q"), (None, None, "q")], "path string, content string, name string")
    got = sorted((r.path or "", r.kind, r.status, r.name or "") for r in P.read_packages(df).collect())
    assert got == [("", "input", "unrecognized", ""), ("a/go.mod", "input", "parsed", ""), ("a/go.mod", "root", "parsed", "m"), ("b/readme.md", "input", "unrecognized", ""), ("c/go.mod", "input", "parsed", "")]
    assert P.read_packages(df.limit(0)).count() == 0

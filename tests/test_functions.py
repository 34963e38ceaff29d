import base64
import hashlib
import posixpath

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import ids, licenses, markers, paths, versions, vocab


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def model_path(p):
    p = (p or "").replace("\\", "/")
    while p.startswith("./"):
        p = p[2:]
    return p[5:] if p.startswith("/src/") else p


def test_normalize_path(spark):
    values = [None, "", "./a", "././a/b", ".\\a\\b", "/src/x", "./" + "/src/x", "/src//src/x", "src/x", "../x", "/a", "." * 5 + "/x", "a/./b"]
    assert column(spark, values, ids.normalize_path) == [model_path(v) for v in values]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="./\\srca ", max_size=12), min_size=40, max_size=40))
def test_normalize_path_any_text(spark, values):
    assert column(spark, values, ids.normalize_path) == [model_path(v) for v in values]


def test_line_free_fingerprint_collapses_like_a_path(spark):
    values = ["a//b", "./a/b", "a/./b", "a/b/", "/src/a", "a/../b", ".//a"]
    want = [hashlib.sha256(("r+" + str(__import__("pathlib").PurePosixPath(v))).encode()).hexdigest() for v in values]
    assert column(spark, values, lambda c: ids.linefree_fingerprint(F.lit("r"), c)) == want


def test_redaction(spark):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()[:8]
    assert column(spark, [None, "", "12345678", "123456789"], ids.redacted) == ["", "", "***" + h("12345678"), "1234…***" + h("123456789")]


def test_hashes_of_lock_files(spark):
    raw = hashlib.sha256(b"x").digest()
    good = "h1:" + base64.b64encode(raw).decode()
    assert column(spark, [good, good[:-2] + "==", "h2:x", None], ids.module_hash) == [raw.hex(), None, None, None]
    s512 = base64.b64encode(hashlib.sha512(b"x").digest()).decode()
    got = column(spark, [f"sha512-{s512} sha1-AAAA sha512-{s512}", None, "junk"], ids.integrity)
    assert [[(r.algorithm, r.digest) for r in x] for x in got] == [[("sha512", hashlib.sha512(b"x").hexdigest())], [], []]
    assert column(spark, ["https://r/x", "file:///x", None], ids.registry_hash) == [hashlib.sha256(b"https://r/x").hexdigest(), None, None]


def test_canonical_digest(spark):
    want = "k:sha256:" + hashlib.sha256(b'{"a":[1,null],"b":"\\u00e9"}').hexdigest()
    assert column(spark, ['{"b": "é", "a": [1, null]}', None], lambda c: ids.canonical_digest("k", c)) == [want, None]


@pytest.mark.parametrize(
    "args,want",
    [
        (("npm", "@a/b", "1.2.3"), "pkg:npm/%40a/b@1.2.3"), (("npm", "a/b", "1.2.3"), None), (("npm", "a", "01.2.3"), None), (("pypi", "a-b", "1.0"), "pkg:pypi/a-b@1.0"),
        (("pypi", "A_b", "1.0"), None), (("pypi", "a", "1.0.0-beta"), None), (("golang", "x.y/z", "v1.2.3"), "pkg:golang/x.y/z@v1.2.3"), (("golang", "x.y/z", "1.2.3"), None),
        (("maven", "g/a", "1"), "pkg:maven/g/a@1"), (("maven", "a", "1"), None), (("cargo", "a", "1.2.3+b"), "pkg:cargo/a@1.2.3%2Bb"), (("cargo", "a", "latest"), None),
        (("nuget", "A", "1.0"), None), (("x", "a", "1"), None), (("npm", "a", None), "pkg:npm/a"), (("npm", None, None), None), (("gem", "../a", "1"), None),
    ],
)
def test_purl(args, want):
    assert ids.package_purl(*args) == want


def test_path_facets(spark):
    values = ["src/a.py", "Vendor/x.js", "x/test_a.py", "docs/readme.md", "a.min.js", "README.MD", "a/gen/x.go", "Dockerfile.prod", "x/compose.yml", "main.tf", "noext", ".py", "a/.b.c.TS"]
    assert column(spark, values, paths.path_class) == ["production", "vendored", "test", "docs", "generated", "docs", "generated"] + ["production"] * 6
    assert column(spark, values, lambda c: paths.extension(paths.base_name(c))) == [
        posixpath.splitext(v.rsplit("/", 1)[-1])[1].lower() for v in values
    ]
    assert column(spark, values, paths.infrastructure)[7:10] == ["dockerfile", "compose", "terraform"]
    formats = ["a/package-lock.json", "pylock.dev.toml", "x.py.lock", "a.dist-info/METADATA", "b.egg-info/PKG-INFO", "METADATA", "reqs.in", "go.sum", "x.json"]
    assert column(spark, formats, paths.package_format) == ["npm-lock", "python-pylock", "python-uv-script-lock", "python-installed-metadata", "python-installed-metadata", None, "pip-requirements", "go-sum", None]
    assert column(spark, formats, lambda c: paths.ecosystem_of(paths.package_format(c))) == ["npm"] + ["pypi"] * 4 + [None, "pypi", "golang", None]
    assert column(spark, ["a/b/c", "x"], paths.ancestors) == [[".", "a", "a/b", "a/b/c"], [".", "x"]]


def test_severities(spark):
    v = [None, "", "CRITICAL ", "low", "weird"]
    assert column(spark, v, vocab.severity_rank) == [1, 0, 4, 1, 0]
    assert column(spark, v, vocab.report_rank) == [2, 1, 4, 1, 1]
    assert column(spark, v, vocab.display_order) == [3, 4, 0, 3, 4]
    assert column(spark, ["error", "WARNING", None], lambda c: vocab.semgrep_report_severity(c, F.lit("HIGH"))) == ["critical", "high", "high"]
    assert column(spark, ["error", "warning", "info", None], lambda c: vocab.semgrep_severity(c, F.lit(None))) == ["high", "medium", "medium", "medium"]


@pytest.mark.parametrize(
    "v,r,want",
    [("1.2", "1.1", True), ("1.0", "[1]", True), ("1.0", "[1.0.0.1]", False), ("2", "(1,2)", False), ("2", "(1,2]", True), ("1", "(,1]", True), ("1", "[,1]", None), ("1", "(,)", None),
     ("x", "1", None), ("1", "~1", None), ("1", "[2,1]", None), ("1", "(1,1]", None), ("1", "[1,1]", True), ("1.5", "[1, 2 )", True), (None, "1", None), ("1", None, None), ("1.2.3.4.5", "1", None)],
)
def test_nuget(spark, v, r, want):
    df = spark.createDataFrame([(v, r)], "v string, r string")
    assert df.select(versions.nuget_satisfies(F.col("v"), F.col("r"))).first()[0] == want


@pytest.mark.parametrize(
    "v,r,want",
    [("1.2.3", "^1.2.0", True), ("2.0.0", "^1.2.0", False), ("0.2.5", "^0.2.3", True), ("0.3.0", "^0.2.3", False), ("0.0.4", "^0.0.3", False), ("1.2.9", "~1.2.3", True), ("1.3.0", "~1.2.3", False),
     ("1.9.0", "~1", True), ("1.2.3", "1.x", True), ("1.2.3", "*", True), ("1.2.3", "", True), ("1.5.0", "1.2 - 1.4", False), ("1.4.9", "1.2 - 1.4", True), ("3.0.0", "<2 || >=3", True),
     ("1.2.3-beta.2", "^1.2.3-beta.1", True), ("1.2.4-beta.2", "^1.2.3-beta.1", False), ("1.2.3-beta", ">=1.0.0", False), ("2.0.0-rc", "<2.0.0", False), ("1.2.3", ">1.2", False), ("1.3.0", ">1.2", True),
     ("1.2.3", "<=1.2", True), ("x", "1", None), ("1.0.0", "foo", None), ("1.2.3", ">= 1.2.0 <1.3.0", True), ("1.0.0-a.10", ">1.0.0-a.9 <2.0.0", True), ("0.1.0", "^0", True), ("1.0.0", "^0.x", False)],
)
def test_npm(v, r, want):
    assert versions.npm_satisfies(v, r) == want


@pytest.mark.parametrize("v,r,want", [("1.2.3", "^1.2", True), ("2.0", "^1.2", False), ("0.2.9", "~0.2.3", True), ("1.4", ">=1,<2", True), ("1.4", "==1.*", True), ("1", "*", True), ("x", "*", None), ("1", "??", None), ("3", "<2 || >=3", True), ("1.4.5", "~=1.4.2", True), ("1.0", "1.0", True)])
def test_pep440(v, r, want):
    assert versions.pep440_satisfies(v, r) == want


def test_license_parsing_and_policy():
    assert licenses.parsed("mit or apache-2.0") == ("MIT OR Apache-2.0", "canonical")
    assert licenses.parsed("GPL-2.0") == ("GPL-2.0", "deprecated") and licenses.parsed("LicenseRef-x")[1] == "licenseref"
    assert licenses.parsed("NOASSERTION") == licenses.parsed(None) == (None, "unparsed")
    p = licenses.LicensePolicy(["MIT", "BSD-*", "GPL-2.0-only WITH Classpath-exception-2.0"], ["GPL-*", "LicenseRef-bad"])
    cases = {
        "MIT": "permitted", "MIT OR GPL-3.0-only": "permitted", "MIT AND GPL-3.0-only": "denied", "GPL-2.0-only WITH Classpath-exception-2.0": "permitted", "Apache-2.0": "undetermined",
        "Apache-2.0 AND MIT": "undetermined", "GPL-2.0-only OR GPL-3.0-only": "denied", "(Apache-2.0 OR BSD-3-Clause) AND MIT": "permitted", "LicenseRef-bad": "denied", "LicenseRef-other": "undetermined",
        "nonsense": "undetermined", "Apache-2.0 OR GPL-3.0-only": "undetermined",
    }
    assert {k: p.verdict(k) for k in cases} == cases
    assert licenses.LicensePolicy([], ["GPL-*"]).verdict("Apache-2.0") == "permitted"
    for bad in ("MIT OR X", "", "(MIT)", "A WITH", "G* WITH E"):
        with pytest.raises(ValueError):
            licenses.LicensePolicy([bad])
    assert licenses.stated_value(" a \n b ") == "a b" and licenses.stated_value({"b": 1, "a": None}) == '{"a":null,"b":1}' and licenses.stated_value(" ") is None


def test_markers():
    env = {"python_version": "3.12", "sys_platform": "linux"}
    cases = {None: "active", "python_version >= '3.8'": "active", "sys_platform == 'win32'": "inactive", "os_name == 'nt' or python_version > '3'": "unknown", "junk": "unknown", "'a' == 'a'": "unknown"}
    assert {k: markers.activation(k, env) for k in cases} == cases
    assert markers.disjoint("python_version < '3.8'", "python_version >= '3.8'") and markers.disjoint("sys_platform == 'x' and os_name == 'a'", "sys_platform != 'x'")
    assert not markers.disjoint("sys_platform == 'a'", "sys_platform == 'b'") and not markers.disjoint(None, "sys_platform == 'b'") and not markers.disjoint("python_version < 'x'", "python_version >= 'x'")


def test_composer_license(spark):
    df = spark.createDataFrame([(["MIT", "GPL-2.0-only AND X"],), (["A B"],), ([],), (None,)], "v array<string>")
    assert [r[0] for r in df.select(licenses.composer_license(F.col("v"))).collect()] == ["MIT OR (GPL-2.0-only AND X)", "A B", None, None]


def test_license_bounds():
    name = lambda n: "LicenseRef-" + "a" * (n - 11)
    many = lambda n, op="OR", x="MIT": f" {op} ".join([x] * (n + 1))
    nested = lambda n: "(" * n + "MIT" + ")" * n
    within = [name(4097), name(16_384), many(128), many(128, "and"), many(128, x="GPL-2.0-only WITH Classpath-exception-2.0"), nested(32)]
    assert all(licenses.parsed(x)[1] != "unparsed" for x in within)
    assert all(licenses.parsed(x) == (None, "unparsed") for x in (name(16_385), many(129), many(129, "and"), nested(33)))
    assert licenses.stated_value("x" * 16_384) and licenses.stated_value("x" * 16_385) is None

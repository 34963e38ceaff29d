"""What a path says: class, language, infrastructure, manifest format and ecosystem; globs."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, functions as F

from lodestrata.functions.vocab import lookup

# Fixed values.
LANGUAGES = {
    "c": ".c .h", "cpp": ".cc .cpp .cxx .hh .hpp .hxx", "csharp": ".cs", "go": ".go", "java": ".java", "kotlin": ".kt .kts", "scala": ".scala",
    "javascript": ".js .mjs .cjs .jsx", "typescript": ".ts .mts .cts .tsx", "python": ".py .pyi", "ruby": ".rb", "php": ".php", "rust": ".rs",
    "swift": ".swift", "objective-c": ".m .mm", "dart": ".dart", "lua": ".lua", "perl": ".pl .pm", "r": ".r", "elixir": ".ex .exs", "erlang": ".erl",
    "haskell": ".hs", "clojure": ".clj", "shell": ".sh .bash .zsh", "powershell": ".ps1", "sql": ".sql", "vue": ".vue", "svelte": ".svelte", "solidity": ".sol",
}
INFRASTRUCTURE_NAMES = {
    "dockerfile": "Dockerfile Containerfile", "helm": "Chart.yaml", "compose": "docker-compose.yml docker-compose.yaml compose.yml compose.yaml",
}
INFRASTRUCTURE_EXTENSIONS = {"terraform": ".tf .tfvars", "bicep": ".bicep", "dockerfile": ".dockerfile", "yaml-candidate": ".yaml .yml"}
PATH_CLASSES = ["vendored", "generated", "test", "docs"]
CLASS_DIRECTORIES = {
    "vendored": "vendor vendors node_modules third_party third-party thirdparty bower_components pods",
    "generated": "generated __generated__ gen",
    "test": "test tests __tests__ testdata testing spec fixtures e2e",
    "docs": "docs doc documentation examples example samples sample curriculum",
}
CLASS_NAMES = {
    "generated": r"(\.pb\.go|\.pb\.cc|\.pb\.h|_pb2\.py|_pb2_grpc\.py|\.min\.js|\.min\.css|\.generated\.go|\.generated\.ts|\.g\.dart|\.freezed\.dart)$|^zz_generated",
    "test": r"(_test\.go|_test\.py|_test\.rb|_spec\.rb|Test\.java|Tests\.java|Test\.kt|Tests\.cs)$|^test_|\.test\.|\.spec\.",
}
DOC_EXTENSIONS = [".md", ".markdown", ".rst", ".adoc", ".ipynb"]
FORMAT_NAMES = {
    "python-pyproject": "pyproject.toml", "python-setup-cfg": "setup.cfg", "python-setup-static": "setup.py", "python-pipfile": "Pipfile",
    "python-pipfile-lock": "Pipfile.lock", "python-poetry-lock": "poetry.lock", "python-uv-lock": "uv.lock", "python-pdm-lock": "pdm.lock",
    "npm-manifest": "package.json", "npm-lock": "package-lock.json npm-shrinkwrap.json", "pnpm-lock": "pnpm-lock.yaml", "yarn-lock": "yarn.lock",
    "go-mod": "go.mod", "go-sum": "go.sum", "cargo-manifest": "Cargo.toml", "cargo-lock": "Cargo.lock", "maven-pom": "pom.xml",
    "gradle-manifest": "build.gradle build.gradle.kts", "gradle-lock": "gradle.lockfile buildscript-gradle.lockfile", "nuget-lock": "packages.lock.json",
    "nuget-packages": "packages.config", "bundler-manifest": "Gemfile", "bundler-lock": "Gemfile.lock", "composer-manifest": "composer.json",
    "composer-lock": "composer.lock",
}
ECOSYSTEMS = {"python": "pypi", "pip": "pypi", "npm": "npm", "pnpm": "npm", "yarn": "npm", "go": "golang", "cargo": "cargo", "maven": "maven", "gradle": "maven", "nuget": "nuget", "bundler": "gem", "composer": "composer"}


def _inverted(table: dict[str, str]) -> dict[str, str]:
    return {x: k for k, v in table.items() for x in v.split()}


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """The last suffix in lower case; leading dots start no suffix."""
    return F.lower(F.regexp_extract(name, r"[^.]\.*?(\.[^.]*)$", 1))


def language(path: Column) -> Column:
    return lookup(extension(base_name(path)), _inverted(LANGUAGES))


def infrastructure(path: Column) -> Column:
    name = base_name(path)
    prefixed = F.when(name.startswith("Dockerfile."), "dockerfile")
    return F.coalesce(lookup(name, _inverted(INFRASTRUCTURE_NAMES)), prefixed, lookup(extension(name), _inverted(INFRASTRUCTURE_EXTENSIONS)))


def path_class(path: Column) -> Column:
    """The first class in order whose directories (any letter case) or file names fit; else production."""
    parts = F.split(path, "/")
    directories = F.transform(F.slice(parts, 1, F.size(parts) - 1), F.lower)
    name = base_name(path)
    out = F.lit(None)
    for c in PATH_CLASSES:
        fits = F.arrays_overlap(directories, F.array(*map(F.lit, CLASS_DIRECTORIES[c].split())))
        if c in CLASS_NAMES:
            fits = fits | name.rlike(CLASS_NAMES[c])
        if c == "docs":
            fits = fits | extension(name).isin(*DOC_EXTENSIONS)
        out = F.coalesce(out, F.when(fits, c))
    return F.coalesce(out, F.lit("production"))


def package_format(path: Column) -> Column:
    """The format a package file is read as; null if it is none."""
    name, parent = base_name(path), F.lower(F.element_at(F.concat(F.array(F.lit(""), F.lit("")), F.split(path, "/")), -2))
    lower = F.lower(name)
    installed = ((name == "METADATA") & parent.endswith(".dist-info")) | ((name == "PKG-INFO") & parent.endswith(".egg-info")) | lower.endswith(".egg-info")
    return F.coalesce(
        lookup(name, _inverted(FORMAT_NAMES)),
        F.when(name.rlike(r"^pylock(\.[^.]+)?\.toml$"), "python-pylock")
        .when(name.endswith(".py.lock"), "python-uv-script-lock")
        .when(installed, "python-installed-metadata")
        .when(extension(name).isin(".in", ".txt", ".pip") & name.rlike(r"\.(in|txt|pip)$"), "pip-requirements"),
    )


def ecosystem_of(fmt: Column) -> Column:
    return lookup(F.substring_index(fmt, "-", 1), ECOSYSTEMS)


def manifest_type(path: Column) -> Column:
    name = base_name(path)
    return F.coalesce(lookup(name, _inverted(FORMAT_NAMES)), F.when(name.rlike(r"^requirements.*\.txt$"), "pip-requirements"))


def glob_pattern(glob: str) -> str:
    """A shell glob as an anchored regular expression of Java; `*` also crosses `/`."""
    return "(?s)^" + fnmatch.translate(glob).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z") + "$"


def ancestors(path: Column) -> Column:
    """Every directory above a path and the path itself, `.` first."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.concat(F.array(F.lit(".")), above)

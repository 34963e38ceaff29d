"""Package files as rows: one parser per format, applied to (path, content) in Arrow batches.

Grammars with nesting, quoting and continuation can't be written with built-in expressions, so each
file is parsed whole by a plain function; files are independent, so this is one narrow stage however
many there are. A parser refuses a file it can't vouch for (status `failed` or `unsupported` with a
reason) instead of returning a part of it.

Rows: path, format, ecosystem, status, reason, kind (package, declaration, edge, include), name,
version, range, scopes, marker, extras, parent, license, hashes, registry_sha256, locator.
"""

from __future__ import annotations

import base64
import binascii
import configparser
import hashlib
import json
import re
import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lodestrata.functions.licenses import stated_value
from lodestrata.functions.paths import ECOSYSTEMS, _inverted, FORMAT_NAMES

TEXTS = ["path", "format", "ecosystem", "status", "reason", "kind", "name", "version", "range", "marker", "parent", "license", "registry_sha256", "locator"]
LISTS = ["scopes", "extras", "hashes"]
SCHEMA = StructType([*[StructField(c, StringType()) for c in TEXTS], *[StructField(c, ArrayType(StringType())) for c in LISTS]])
NUMERIC = re.compile(r"[0-9]+(\.[0-9]+){0,3}")


class Refused(ValueError):
    """The file as a whole is not read; the reason never holds its text."""

    def __init__(self, reason: str, status: str = "failed"):
        super().__init__(reason)
        self.reason, self.status = reason, status


def row(kind: str, name: str, **more) -> dict:
    return {"kind": kind, "name": name, **more}


def _once(pairs):
    out = {}
    for k, v in pairs:
        if k in out:
            raise Refused("duplicate-key")
        out[k] = v
    return out


def load_json(text: str) -> dict:
    try:
        data = json.loads(text, object_pairs_hook=_once)
    except (json.JSONDecodeError, RecursionError):
        raise Refused("invalid-json") from None
    return mapping(data)


def load_toml(text: str) -> dict:
    try:
        return tomllib.loads(text)
    except (tomllib.TOMLDecodeError, RecursionError):
        raise Refused("invalid-toml") from None


def mapping(value) -> dict:
    if not isinstance(value, dict):
        raise Refused("unexpected-shape")
    return value


def listing(value) -> list:
    if not isinstance(value, list):
        raise Refused("unexpected-shape")
    return value


def word(value) -> str:
    if not isinstance(value, str) or not value:
        raise Refused("unexpected-shape")
    return value


def registry(value) -> str | None:
    return hashlib.sha256(value.encode()).hexdigest() if isinstance(value, str) and re.match(r"https?://", value) else None


def integrity(value) -> list[str]:
    sizes = {"sha1": 20, "sha256": 32, "sha384": 48, "sha512": 64}
    out = set()
    for item in (value or "").split():
        name, _, body = item.partition("-")
        try:
            raw = base64.b64decode(body, validate=True)
        except (binascii.Error, ValueError):
            continue
        if sizes.get(name) == len(raw) and base64.b64encode(raw).decode() == body:
            out.add(f"{name}:{raw.hex()}")
    return sorted(out)


def normal_name(name: str) -> str:
    return re.sub(r"[-_.]+", "-", name).lower()


def requirement(text: str, locator: str, scopes: list[str], kind: str = "declaration") -> dict:
    from packaging.requirements import InvalidRequirement, Requirement

    try:
        r = Requirement(text)
    except InvalidRequirement:
        raise Refused("invalid-requirement") from None
    exact = [s for s in r.specifier if s.operator in ("==", "===") and "*" not in s.version]
    version = exact[0].version if len(r.specifier) == 1 and exact else None
    return row(kind, normal_name(r.name), version=version, range=str(r.specifier) or None, marker=str(r.marker) if r.marker else None,
               extras=sorted(r.extras), scopes=scopes, locator=locator, registry_sha256=registry(r.url))


def logical_lines(text: str) -> Iterator[tuple[int, str]]:
    """Lines joined over trailing backslashes, comments cut off, with the number of the first."""
    held, start = "", 0
    for number, line in enumerate(text.splitlines(), 1):
        start = start or number
        body = re.sub(r"(^|\s)#.*$", "", line)
        if body.endswith("\\"):
            held += body[:-1] + " "
            continue
        if (held + body).strip():
            yield start, (held + body).strip()
        held, start = "", 0
    if held.strip():
        yield start, held.strip()


def requirements_txt(text: str) -> list[dict]:
    out = []
    for number, line in logical_lines(text):
        at = f"line:{number}"
        include = re.fullmatch(r"(-r|--requirement|-c|--constraint)(?:\s+|=)(\S+)", line)
        if include:
            role = "constraint" if "c" in include[1].lstrip("-")[:1] else "requirement"
            out.append(row("include", include[2], scopes=[role], locator=at))
            continue
        if line.startswith("-"):
            if re.match(r"(-e|--editable)\b", line):
                raise Refused("editable-requirement", "unsupported")
            continue
        hashes = sorted(set(re.findall(r"--hash[= ](\w+:[0-9a-f]+)", line)))
        out.append(requirement(re.sub(r"\s--[\w-]+(?:[= ]\S+)?", "", line).strip(), at, ["runtime"]) | {"hashes": hashes})
    return out


def pyproject(text: str) -> list[dict]:
    data = load_toml(text)
    out: list[dict] = []
    project = mapping(data.get("project", {}))
    dynamic = listing(project.get("dynamic", []))
    if {"dependencies", "optional-dependencies"} & set(dynamic):
        raise Refused("dynamic-dependencies", "unsupported")
    groups = [("project/dependencies", project.get("dependencies", []), ["runtime"])]
    groups += [(f"project/optional-dependencies/{g}", v, [f"extra:{g}"]) for g, v in mapping(project.get("optional-dependencies", {})).items()]
    groups += [("build-system/requires", mapping(data.get("build-system", {})).get("requires", []), ["build"])]
    for g, v in mapping(data.get("dependency-groups", {})).items():
        groups.append((f"dependency-groups/{g}", [x for x in listing(v) if isinstance(x, str)], [f"group:{g}"]))
    for where, items, scopes in groups:
        out += [requirement(word(x), f"{where}/{i}", scopes) for i, x in enumerate(listing(items))]
    poetry = mapping(mapping(data.get("tool", {})).get("poetry", {}))
    for where, scopes in (("dependencies", ["runtime"]), ("dev-dependencies", ["development"])):
        for name, v in mapping(poetry.get(where, {})).items():
            if name != "python":
                spec = v if isinstance(v, str) else mapping(v).get("version") if isinstance(v, dict) else None
                out.append(row("declaration", normal_name(name), range=spec, scopes=scopes, locator=f"tool/poetry/{where}/{name}"))
    return out


def setup_cfg(text: str) -> list[dict]:
    parser = configparser.ConfigParser(interpolation=None, strict=True)
    try:
        parser.read_string(text)
    except configparser.Error:
        raise Refused("invalid-setup-cfg") from None
    out = []
    for section, option, scopes in (("options", "install_requires", ["runtime"]), ("options", "setup_requires", ["build"]), ("options", "tests_require", ["test"])):
        items = parser.get(section, option, fallback="").splitlines()
        out += [requirement(x.strip(), f"{section}/{option}/{i}", scopes) for i, x in enumerate(items) if x.strip()]
    if parser.has_section("options.extras_require"):
        for extra, value in parser.items("options.extras_require"):
            out += [requirement(x.strip(), f"extras/{extra}/{i}", [f"extra:{extra}"]) for i, x in enumerate(value.splitlines()) if x.strip()]
    return out


def setup_py(text: str) -> list[dict]:
    """Only literal arguments of a setup() call; anything computed is refused, nothing is run."""
    import ast

    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        raise Refused("invalid-setup-py") from None
    calls = [n for n in ast.walk(tree) if isinstance(n, ast.Call) and getattr(n.func, "id", getattr(n.func, "attr", "")) == "setup"]
    if len(calls) != 1 or any(k.arg is None for k in calls[0].keywords):
        raise Refused("dynamic-setup-py", "unsupported")
    out = []
    for k in calls[0].keywords:
        if k.arg not in ("install_requires", "setup_requires", "tests_require", "extras_require"):
            continue
        try:
            value = ast.literal_eval(k.value)
        except (ValueError, TypeError):
            raise Refused("dynamic-setup-py", "unsupported") from None
        scopes = {"install_requires": "runtime", "setup_requires": "build", "tests_require": "test"}
        groups = {f"extra:{e}": v for e, v in value.items()} if isinstance(value, dict) else {scopes[k.arg]: value}
        for scope, items in groups.items():
            out += [requirement(x, f"{k.arg}/{scope}/{i}", [scope]) for i, x in enumerate(items.splitlines() if isinstance(items, str) else items)]
    return out


def pipfile_lock(text: str) -> list[dict]:
    data, out = load_json(text), []
    for group, scope in (("default", "runtime"), ("develop", "development")):
        for name, v in mapping(data.get(group, {})).items():
            version = mapping(v).get("version")
            if not isinstance(version, str) or not version.startswith("=="):
                continue
            out.append(row("package", normal_name(name), version=version.lstrip("="), scopes=[scope], marker=v.get("markers"), extras=sorted(v.get("extras", [])),
                           hashes=sorted(set(v.get("hashes", []))), registry_sha256=registry(v.get("index")), locator=f"/{group}/{name}"))
    return out


def toml_lock(text: str) -> list[dict]:
    """poetry, pdm, uv and pylock: arrays of packages with dependencies by name."""
    data = load_toml(text)
    packages = data.get("package", data.get("packages", []))
    out = []
    for i, p in enumerate(listing(packages)):
        p = mapping(p)
        name, at = normal_name(word(p.get("name"))), f"/package/{i}"
        scopes = p.get("groups") or (["development"] if p.get("category") == "dev" else ["runtime"])
        files = p.get("files") or p.get("wheels") or []
        hashes = sorted({f["hash"] for f in files if isinstance(f, dict) and isinstance(f.get("hash"), str)})
        source = p.get("source") if isinstance(p.get("source"), dict) else {}
        out.append(row("package", name, version=p.get("version"), scopes=sorted(scopes), hashes=hashes, marker=p.get("marker") or p.get("markers"),
                       extras=sorted(p.get("extras", [])) if isinstance(p.get("extras"), list) else [], registry_sha256=registry(source.get("registry") or source.get("url")), locator=at))
        wanted = p.get("dependencies", {})
        if isinstance(wanted, dict):
            for child, spec in wanted.items():
                spec = spec if isinstance(spec, dict) else {"version": spec}
                out.append(row("edge", normal_name(child), parent=name, range=spec.get("version"), marker=spec.get("markers"), extras=sorted(spec.get("extras", [])), locator=f"{at}/dependencies/{child}"))
        else:
            for j, spec in enumerate(wanted):
                at_child = f"{at}/dependencies/{j}"
                if isinstance(spec, str):
                    out.append(requirement(spec, at_child, [], "edge") | {"parent": name})
                else:
                    out.append(row("edge", normal_name(word(mapping(spec).get("name"))), parent=name, version=spec.get("version"), marker=spec.get("marker"), extras=sorted(spec.get("extra", [])), locator=at_child))
    return out


def installed_metadata(text: str) -> list[dict]:
    from email.parser import Parser

    head = Parser().parsestr(text, headersonly=True)
    name, version = head.get("Name"), head.get("Version")
    if not name or not version:
        raise Refused("incomplete-metadata")
    trove = [x.split(" :: ")[-1] for x in head.get_all("Classifier", []) if x.startswith("License ::")]
    claim = head.get("License-Expression") or head.get("License") or (" OR ".join(trove) if len(trove) == 1 else None)
    out = [row("package", normal_name(name), version=version, scopes=["installed"], license=stated_value(claim), locator="/Name")]
    for i, x in enumerate(head.get_all("Requires-Dist", [])):
        out.append(requirement(x, f"/Requires-Dist/{i}", ["runtime"]) | {"parent": normal_name(name)})
    return out


def package_json(text: str) -> list[dict]:
    data = load_json(text)
    optional = mapping(data.get("optionalDependencies") or {})
    out = []
    tables = (("dependencies", "runtime"), ("devDependencies", "development"), ("optionalDependencies", "optional"), ("peerDependencies", "peer"))
    for table, scope in tables:
        for name, spec in mapping(data.get(table) or {}).items():
            if table == "dependencies" and name in optional:
                continue  # the optional entry of a name takes its place
            out.append(row("declaration", name, range=word(spec) if spec else "", scopes=[scope], locator=f"/{table}/{name}"))
    if isinstance(data.get("name"), str):
        out.append(row("root", data["name"], version=data.get("version"), license=stated_value(data.get("license")), locator="/"))
    return out


def npm_lock(text: str) -> list[dict]:
    data = load_json(text)
    if data.get("lockfileVersion") not in (2, 3):
        raise Refused("lockfile-version", "unsupported")
    out = []
    for path, p in mapping(data.get("packages")).items():
        p = mapping(p)
        if path and not p.get("link"):
            name = p.get("name") or path.rpartition("node_modules/")[2]
            if p.get("extraneous"):
                scopes = ["unknown"]
            elif p.get("peer"):
                scopes = ["peer"]
            else:
                scopes = (["development"] if p.get("dev") or p.get("devOptional") else []) + (["optional"] if p.get("optional") or p.get("devOptional") else [])
            out.append(row("package", name, version=p.get("version"), scopes=scopes or ["runtime"], hashes=integrity(p.get("integrity")), registry_sha256=registry(p.get("resolved")),
                           license=stated_value(p.get("license")), locator=path))
        optional = set(p.get("optionalDependencies") or {})
        tables = ("dependencies", "optionalDependencies", "peerDependencies") + (("devDependencies",) if not path else ())
        for table in tables:
            for child, spec in mapping(p.get(table) or {}).items():
                if table != "dependencies" or child not in optional:
                    out.append(row("edge", child, parent=path, range=spec, scopes=[table], locator=f"{path}#{table}/{child}"))
    return out


def _yaml(text: str) -> dict:
    import yaml

    if len(re.findall(r"(?m)(?:^|\s)[&*]\w", text)) > 0:
        raise Refused("yaml-alias", "unsupported")
    try:
        return mapping(yaml.safe_load(text))
    except (yaml.YAMLError, RecursionError):
        raise Refused("invalid-yaml") from None


def _descriptor(key: str) -> tuple[str, str]:
    name, _, rest = key.lstrip("/").rpartition("@")
    return name, re.sub(r"\(.*$", "", rest)


def pnpm_lock(text: str) -> list[dict]:
    data, out = _yaml(text), []
    importers = data.get("importers") or {".": data}
    for importer, tables in mapping(importers).items():
        for table, scope in (("dependencies", "runtime"), ("devDependencies", "development"), ("optionalDependencies", "optional")):
            for name, v in mapping(tables.get(table) or {}).items():
                v = v if isinstance(v, dict) else {"specifier": None, "version": v}
                selected = re.sub(r"\(.*$", "", str(v.get("version")))
                out.append(row("edge", name, parent=importer, version=selected, range=v.get("specifier"), scopes=[scope], locator=f"/importers/{importer}/{table}/{name}"))
    snapshots = mapping(data.get("snapshots") or {})
    for key, p in mapping(data.get("packages") or {}).items():
        name, version = _descriptor(re.sub(r"\(.*$", "", key))
        p = mapping(p or {})
        out.append(row("package", name, version=version, hashes=integrity(mapping(p.get("resolution") or {}).get("integrity")), locator=f"/packages/{key}"))
        for child, v in mapping((snapshots.get(key) or p).get("dependencies") or {}).items():
            out.append(row("edge", child, parent=key, version=re.sub(r"\(.*$", "", str(v)), locator=f"/packages/{key}/dependencies/{child}"))
    return out


def yarn_lock(text: str) -> list[dict]:
    """Both dialects: blocks of descriptors with indented members."""
    out: list[dict] = []
    owners: dict[str, str] = {}
    current, section, name = None, "", ""
    for number, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.startswith("#"):
            continue
        depth = len(line) - len(line.lstrip(" "))
        body = line.strip()
        if depth == 0:
            keys = [k.strip().strip('"') for k in re.split(r",\s*", body.rstrip(":").strip('"'))]
            section, current = "", None
            if keys == ["__metadata"]:
                continue
            name = re.sub(r"@(?:npm:)?[^@]*$", "", keys[0])
            for k in keys:
                if owners.setdefault(k, keys[0]) != keys[0]:
                    raise Refused("descriptor-of-two-packages")
            current = row("package", name, locator=f"line:{number}", extras=sorted(keys))
            out.append(current)
        elif current is not None and depth == 2:
            key, _, value = re.sub(r'^"?([^"\s:]+)"?:?\s*', r"\1\0", body).partition("\0")
            section = key if not value else ""
            value = value.strip().strip('"')
            if key == "version":
                current["version"] = value
            elif key == "resolved":
                current["registry_sha256"] = registry(value.split("#")[0])
            elif key == "integrity":
                current["hashes"] = integrity(value)
            elif key == "resolution" and "@npm:" not in value:
                current["scopes"] = ["local"]
        elif current is not None and section in ("dependencies", "optionalDependencies"):
            m = re.fullmatch(r'"?([^"\s]+?)"?:?\s+"?([^"]*)"?', body)
            if not m:
                raise Refused("invalid-yarn-lock")
            out.append(row("edge", m[1], parent=current["extras"][0], range=m[2].removeprefix("npm:"), scopes=[section], locator=f"line:{number}"))
    return out


def cargo_lock(text: str) -> list[dict]:
    out = []
    for i, p in enumerate(listing(load_toml(text).get("package", []))):
        name, version, at = word(p.get("name")), word(p.get("version")), f"/package/{i}"
        source = p.get("source")
        out.append(row("package", name, version=version, registry_sha256=registry((source or "").removeprefix("registry+").removeprefix("sparse+")), scopes=[] if source else ["local"],
                       hashes=[f"sha256:{p['checksum']}"] if p.get("checksum") else [], locator=at))
        for j, d in enumerate(p.get("dependencies", [])):
            parts = word(d).split(" ")
            where = registry(parts[2].strip("()").removeprefix("registry+").removeprefix("sparse+")) if len(parts) > 2 else None
            out.append(row("edge", parts[0], parent=f"{name} {version}", version=parts[1] if len(parts) > 1 else None, registry_sha256=where, locator=f"{at}/dependencies/{j}"))
    return out


def cargo_toml(text: str) -> list[dict]:
    data, out = load_toml(text), []
    tables = [("", data), *[(f"target/{k}/", v) for k, v in mapping(data.get("target", {})).items()]]
    for where, part in tables:
        for table, scope in (("dependencies", "runtime"), ("dev-dependencies", "development"), ("build-dependencies", "build")):
            for alias, v in mapping(part.get(table, {})).items():
                v = {"version": v} if isinstance(v, str) else mapping(v)
                out.append(row("declaration", v.get("package", alias), range=v.get("version"), scopes=[scope], extras=sorted(v.get("features", [])), marker=where.split("/")[1] if where else None, locator=f"/{where}{table}/{alias}"))
    package = data.get("package")
    if isinstance(package, dict) and isinstance(package.get("name"), str):
        out.append(row("root", package["name"], version=package["version"] if isinstance(package.get("version"), str) else None, license=stated_value(package.get("license")), locator="/package"))
    return out


def go_mod(text: str) -> list[dict]:
    """Requirements only: a module file selects no versions and holds no graph."""
    out, block = [], None
    for number, line in enumerate(text.splitlines(), 1):
        body, _, comment = line.partition("//")
        body = body.strip()
        if not body:
            continue
        if block and body == ")":
            block = None
            continue
        opened = re.fullmatch(r"(\w+)\s*\(", body)
        if opened:
            block = opened[1]
            continue
        words = body.split()
        directive, rest = (block, words) if block else (words[0], words[1:])
        at = f"line:{number}"
        if directive == "require":
            if len(rest) != 2:
                raise Refused("invalid-go-require")
            out.append(row("declaration", rest[0], range=rest[1], scopes=["indirect" if comment.strip().startswith("indirect") else "direct"], locator=at))
        elif directive == "module":
            out.append(row("root", rest[0].strip('"'), locator=at))
        elif directive in ("replace", "exclude", "retract", "tool", "godebug", "ignore"):
            out.append(row("loss", directive, range=" ".join(rest), locator=at))
        elif directive not in ("go", "toolchain"):
            raise Refused("unknown-go-directive", "unsupported")
    return out


def gradle_lock(text: str) -> list[dict]:
    out, chosen, filled, seen = [], {}, set(), set()
    ended = None
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.strip(" \t")
        if not line or line.startswith("#"):
            continue
        if ended is not None:
            raise Refused("text-after-empty-marker")
        if line.count("=") != 1:
            raise Refused("unknown-gradle-line", "unsupported")
        coordinate, listed = line.split("=")
        configurations = sorted(c.strip() for c in listed.split(",") if c.strip())
        if len(set(configurations)) != len(configurations) or (not configurations and coordinate != "empty"):
            raise Refused("invalid-gradle-configurations")
        if coordinate == "empty":
            if filled & set(configurations):
                raise Refused("contradictory-gradle-empty-configuration")
            ended = number
            continue
        parts = coordinate.split(":")
        if len(parts) != 3 or not all(re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", x) for x in parts):
            raise Refused("unknown-gradle-coordinate", "unsupported")
        group, artifact, version = parts
        if re.match(r"(latest|release|head|main|master|unknown)\b", version, re.I):
            raise Refused("unresolved-gradle-version", "unsupported")
        if coordinate in seen:
            raise Refused("duplicate-gradle-coordinate")
        seen.add(coordinate)
        for c in configurations:
            if chosen.setdefault((group, artifact, c), version) != version:
                raise Refused("contradictory-gradle-locked-version")
            filled.add(c)
        out.append(row("package", f"{group}/{artifact}", version=version, scopes=configurations, locator=f"line:{number}"))
    if ended is None:
        raise Refused("missing-gradle-empty-marker", "unsupported")
    return out


def nuget_lock(text: str) -> list[dict]:
    out = []
    for target, packages in mapping(load_json(text).get("dependencies")).items():
        for name, p in mapping(packages).items():
            p = mapping(p)
            if p.get("type") == "Project":
                continue
            out.append(row("package", name.lower(), version=p.get("resolved"), range=p.get("requested"), scopes=[target], marker=p.get("type"), hashes=integrity("sha512-" + p["contentHash"]) if p.get("contentHash") else [],
                           locator=f"/dependencies/{target}/{name}"))
            for child, spec in mapping(p.get("dependencies") or {}).items():
                out.append(row("edge", child.lower(), parent=name.lower(), range=spec, scopes=[target], locator=f"/dependencies/{target}/{name}/dependencies/{child}"))
    return out


def composer_lock(text: str) -> list[dict]:
    data, out, names = load_json(text), [], set()
    for table, scope in (("packages", "runtime"), ("packages-dev", "development")):
        for i, p in enumerate(listing(data.get(table))):
            name = word(mapping(p).get("name"))
            if name in names:
                raise Refused("duplicate-composer-package")
            names.add(name)
            version = word(p.get("version")).removeprefix("v")
            if not NUMERIC.fullmatch(version) or p.get("type") == "metapackage" or (isinstance(p.get("dist"), dict) and p["dist"].get("type") == "path"):
                continue
            stated = p.get("license")
            several = isinstance(stated, list) and len(stated) > 1
            text_ = " OR ".join(f"({x})" if several and " " in x else x for x in stated) if isinstance(stated, list) and all(isinstance(x, str) for x in stated) else stated
            out.append(row("package", name, version=version, scopes=[scope], license=stated_value(text_), locator=f"/{table}/{i}"))
            for control in ("require", "require-dev", "provide", "replace", "conflict"):
                if p.get(control):
                    out.append(row("loss", control, parent=name, locator=f"/{table}/{i}/{control}"))
    return out


def gemfile_lock(text: str) -> list[dict]:
    sections = ("GEM", "PLATFORMS", "DEPENDENCIES", "BUNDLED WITH", "RUBY VERSION", "CHECKSUMS")
    out: list[dict] = []
    section, remote, seen, current = "", None, set(), None
    for number, line in enumerate(text.splitlines(), 1):
        at = f"line:{number}"
        if not line.strip():
            continue
        if not line.startswith(" "):
            if line not in sections or line in seen:
                raise Refused("unknown-bundler-section", "unsupported")
            seen.add(line)
            section = line
        elif section == "GEM":
            spec = re.fullmatch(r" {4}(\S+) \(([^()]+)\)", line)
            if line.startswith("  remote: "):
                if remote:
                    raise Refused("several-bundler-remotes", "unsupported")
                remote = registry(line[10:])
            elif spec:
                if not NUMERIC.fullmatch(spec[2]):
                    raise Refused("bundler-platform-version", "unsupported")
                current = spec[1]
                out.append(row("package", current, version=spec[2], registry_sha256=remote, locator=at))
            elif line.startswith("      ") and current:
                out.append(row("loss", line.split()[0], parent=current, locator=at))
            elif line != "  specs:":
                raise Refused("invalid-bundler-lock")
        elif section == "PLATFORMS" and line.strip() != "ruby":
            raise Refused("bundler-platforms", "unsupported")
        elif section == "DEPENDENCIES":
            m = re.fullmatch(r"  ([\w.-]+)!?(?: \(([^()]+)\))?", line)
            if not m:
                raise Refused("invalid-bundler-declaration")
            out.append(row("declaration", m[1], range=m[2], scopes=["direct"], locator=at))
    if not {"GEM"} <= seen:
        raise Refused("missing-bundler-section")
    return out


PARSERS: dict[str, Callable[[str], list[dict]]] = {
    "pip-requirements": requirements_txt, "python-pyproject": pyproject, "python-setup-cfg": setup_cfg, "python-setup-static": setup_py, "python-pipfile-lock": pipfile_lock,
    "python-poetry-lock": toml_lock, "python-pdm-lock": toml_lock, "python-uv-lock": toml_lock, "python-pylock": toml_lock, "python-uv-script-lock": toml_lock,
    "python-installed-metadata": installed_metadata, "npm-manifest": package_json, "npm-lock": npm_lock, "pnpm-lock": pnpm_lock, "yarn-lock": yarn_lock, "cargo-lock": cargo_lock,
    "cargo-manifest": cargo_toml, "go-mod": go_mod, "gradle-lock": gradle_lock, "nuget-lock": nuget_lock, "composer-lock": composer_lock, "bundler-lock": gemfile_lock,
}
_NAMES = _inverted(FORMAT_NAMES)


def format_of(path: str) -> str | None:
    """As `functions.paths.package_format`, for one path."""
    *above, name = path.split("/")
    parent = above[-1].lower() if above else ""
    if name in _NAMES:
        return _NAMES[name]
    if re.fullmatch(r"pylock(\.[^.]+)?\.toml", name):
        return "python-pylock"
    if name.endswith(".py.lock"):
        return "python-uv-script-lock"
    if (name == "METADATA" and parent.endswith(".dist-info")) or (name == "PKG-INFO" and parent.endswith(".egg-info")) or name.lower().endswith(".egg-info"):
        return "python-installed-metadata"
    return "pip-requirements" if re.search(r".\.(in|txt|pip)$", name) else None


def parse(path: str, content: str | bytes | None) -> list[dict]:
    """All rows of one file, the first of them about the file itself."""
    fmt = format_of(path)
    about = {"path": path, "format": fmt, "ecosystem": ECOSYSTEMS.get((fmt or "").partition("-")[0])}
    status, reason, rows = "parsed", None, []
    try:
        if fmt not in PARSERS:
            raise Refused("no-parser", "unsupported" if fmt else "unrecognized")
        text = content.decode() if isinstance(content, (bytes, bytearray)) else content or ""
        rows = PARSERS[fmt](text.removeprefix("﻿"))
    except Refused as e:
        status, reason = e.status, e.reason
    except UnicodeDecodeError:
        status, reason = "failed", "invalid-encoding"
    except (AttributeError, TypeError, KeyError, ValueError, IndexError):
        status, reason = "failed", "unexpected-shape"
    return [{**about, "kind": "input", "status": status, "reason": reason}, *[{**about, "status": status, **r} for r in rows]]


def read_packages(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Rows of all package files of (path, content); content may be text or bytes."""

    def parsed(batches):
        for batch in batches:
            rows = [r for p, c in zip(batch[path], batch[content]) for r in parse(p or "", c)]
            columns = {c: [r.get(c) for r in rows] for c in TEXTS} | {c: [list(r.get(c) or []) for r in rows] for c in LISTS}
            yield pd.DataFrame(columns)

    return files.select(path, content).mapInPandas(parsed, SCHEMA)

"""Paths, finding identities and digests."""

from __future__ import annotations

import json
import re
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType


def normalize_path(c: Column | str) -> Column:
    r"""`\` becomes `/`, every leading `./` goes, then one leading `/src/`; null gives an empty text."""
    c = F.col(c) if isinstance(c, str) else c
    slashed = F.translate(F.coalesce(c, F.lit("")), "\\", "/")
    return F.regexp_replace(F.regexp_replace(slashed, r"^(\./)+", ""), r"^/src/", "")


def finding_key(rule: Column, file: Column, line: Column) -> Column:
    """The text `rule:normalised file:line` whose SHA-256 is the finding's identity."""
    return F.concat_ws(":", F.coalesce(rule, F.lit("")), normalize_path(file), F.coalesce(line.cast("string"), F.lit("0")))


def compute_finding_id(rule: Column, file: Column, line: Column) -> Column:
    return F.sha2(finding_key(rule, file, line), 256)


def linefree_fingerprint(rule: Column, file: Column) -> Column:
    """Rule and file without the line: `//` and `./` collapse, `/src/` stays."""
    path = F.translate(F.coalesce(file, F.lit("")), "\\", "/")
    path = F.regexp_replace(F.regexp_replace(path, r"/(\./)+", "/"), r"/{2,}", "/")
    path = F.regexp_replace(F.regexp_replace(path, r"^(\./)+", ""), r"(.)/\.?$", "$1")
    return F.sha2(F.concat(F.coalesce(rule, F.lit("")), F.lit("+"), path), 256)


def issue_fingerprint(rule: Column, file: Column) -> Column:
    """Rule and file exactly as given."""
    return F.sha2(F.concat_ws(":", F.coalesce(rule, F.lit("")), F.coalesce(file, F.lit(""))), 256)


def redacted(secret: Column) -> Column:
    """A secret that can't be read back: up to 8 characters vanish, of longer ones four stay, plus eight digits of the hash."""
    digest = F.substring(F.sha2(secret, 256), 1, 8)
    short = F.concat(F.lit("***"), digest)
    return F.when(F.coalesce(secret, F.lit("")) == "", "").when(F.length(secret) <= 8, short).otherwise(
        F.concat(F.substring(secret, 1, 4), F.lit("…"), short)
    )


def _base64(raw: Column) -> Column:
    """Without the line ends that the built-in function puts in."""
    return F.regexp_replace(F.base64(raw), "\r?\n", "")


def module_hash(c: Column) -> Column:
    """`h1:` base64 as hex; null unless it is exactly 32 bytes in canonical base64."""
    body = F.when(c.rlike(r"^h1:[A-Za-z0-9+/]{43}=$"), F.substring(c, 4, 44))
    raw = F.try_to_binary(body, F.lit("base64"))
    return F.when(_base64(raw) == body, F.lower(F.hex(raw)))


DIGEST_BYTES = {"sha1": 20, "sha256": 32, "sha384": 48, "sha512": 64}


def integrity(c: Column) -> Column:
    """`alg-base64 ...` as sorted distinct (algorithm, hex); entries of another length or form are left out."""

    def decoded(x: Column) -> Column:
        algorithm, body = F.substring_index(x, "-", 1), F.regexp_extract(x, r"^[a-z0-9]+-([A-Za-z0-9+/]+=*)$", 1)
        raw = F.try_to_binary(body, F.lit("base64"))
        size = F.lit(None).cast("int")
        for name, n in DIGEST_BYTES.items():
            size = F.when(algorithm == name, n).otherwise(size)
        fits = (F.octet_length(raw) == size) & (_base64(raw) == body)
        return F.when(fits, F.struct(algorithm.alias("algorithm"), F.lower(F.hex(raw)).alias("digest")))

    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.split(trimmed_text(c), r"\s+"), decoded))))


def trimmed_text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def registry_hash(uri: Column) -> Column:
    """SHA-256 of an http(s) address; any other gives null, and the address itself is never kept."""
    return F.when(uri.rlike("^https?://"), F.sha2(uri, 256))


def canonical_json(value) -> str:
    """Sorted keys, no blanks, no NaN: the text whose digest identifies a record."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def canonical_digest(kind: str, members: Column) -> Column:
    """`kind:sha256:` over the canonical JSON of a JSON text."""

    @F.pandas_udf(StringType())
    def canonical(text: pd.Series) -> pd.Series:
        return text.map(lambda t: canonical_json(json.loads(t)), na_action="ignore")

    return F.concat(F.lit(f"{kind}:sha256:"), F.sha2(canonical(members), 256))


NAME_RULES = {
    "pypi": r"[a-z0-9]+(?:-[a-z0-9]+)*", "npm": r"(?:@[^/@]+/)?[^/@]+", "golang": r"[^@]+", "cargo": r"[^/@]+", "maven": r"[^/@]+/[^/@]+",
    "nuget": r"[^/@]+", "gem": r"[^/@]+", "composer": r"[^/@]+/[^/@]+",
}
SEMVER = r"(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){2}(?:-(?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)(?:\.(?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*))*)?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?"
UNRESOLVED = {"latest", "release", "head", "main", "master", "unknown"}


def package_purl(ecosystem: str | None, name: str | None, version: str | None) -> str | None:
    """The package URL, or None where the ecosystem would not accept name or version."""
    rule = NAME_RULES.get(ecosystem or "")
    if not rule or not name or len(name) > 512 or re.search(r"[:?#%\\\s\x00-\x1f]", name) or not re.fullmatch(rule, name):
        return None
    if {"", ".", ".."} & set(name.split("/")) or (ecosystem in ("nuget", "composer") and name != name.lower()):
        return None
    if version is not None:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.!+_-]{0,511}", version) or version.lower() in UNRESOLVED:
            return None
        if ecosystem in ("npm", "cargo", "golang") and not re.fullmatch(("v" if ecosystem == "golang" else "") + SEMVER, version):
            return None
        if ecosystem == "pypi":
            from packaging.version import InvalidVersion, Version

            try:
                if str(Version(version)) != version:
                    return None
            except InvalidVersion:
                return None
    way = "/".join(quote(part, safe="-._~") for part in name.split("/"))
    return f"pkg:{ecosystem}/{way}" + ("" if version is None else "@" + quote(version, safe="-._~"))


@F.pandas_udf(StringType())
def purl(ecosystem: pd.Series, name: pd.Series, version: pd.Series) -> pd.Series:
    return pd.Series([package_purl(*x) for x in zip(ecosystem, name, version)], dtype=object)

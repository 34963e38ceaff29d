"""Version order and ranges of the package ecosystems."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import BooleanType

NUMERIC = r"^[0-9]{1,10}(\.[0-9]{1,10}){0,3}$"


def four_parts(c: Column) -> Column:
    """A dotted version as four numbers, missing ones 0, so arrays compare like versions; null if it is none."""
    c = F.trim(c)
    numbers = F.transform(F.split(c, r"\."), lambda x: x.cast("long"))
    return F.when(c.rlike(NUMERIC), F.slice(F.concat(numbers, F.array_repeat(F.lit(0).cast("long"), 4)), 1, 4))


def nuget_satisfies(version: Column, expression: Column) -> Column:
    """True, false, or null where version or range are outside the grammar: bare = minimum, `[x]`, `(a,b]`."""
    v, e = four_parts(F.when(version.rlike(NUMERIC), version)), F.trim(expression)
    first, last = F.substring(e, 1, 1), F.right(e, F.lit(1))
    inside = F.substring(e, F.lit(2), F.length(e) - 2)
    parts = F.split(inside, ",")
    left, right = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    low, high = four_parts(left), four_parts(right)
    has_low, has_high = left != "", right != ""
    closed = (first == "[") & (last == "]")
    broken = (
        (has_low & low.isNull()) | (has_high & high.isNull()) | ~(has_low | has_high) | (~has_low & (first != "(")) | (~has_high & (last != ")"))
        | F.coalesce((low > high) | ((low == high) & ~closed), F.lit(False))
    )
    above = ~has_low | F.coalesce((v > low) | ((v == low) & (first == "[")), F.lit(False))
    below = ~has_high | F.coalesce((v < high) | ((v == high) & (last == "]")), F.lit(False))
    bare, pair = four_parts(e), e.rlike(r"^[\[(][^,]*,[^,]*[\])]$")
    return (
        F.when(v.isNull() | e.isNull(), None)
        .when(bare.isNotNull(), v >= bare)
        .when(e.rlike(r"^\[[^,]*\]$"), v == four_parts(inside))
        .when(~pair | broken, None)
        .otherwise(above & below)
    )


IDENTIFIER = r"(?:0|[1-9]\d*|\d*[A-Za-z-][0-9A-Za-z-]*)"
_VERSION = re.compile(rf"v?(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-({IDENTIFIER}(?:\.{IDENTIFIER})*))?(?:\+[0-9A-Za-z.-]+)?")
_PARTIAL = rf"[v=\s]*(x|X|\*|0|[1-9]\d*)(?:\.(x|X|\*|0|[1-9]\d*)(?:\.(x|X|\*|0|[1-9]\d*)(?:-({IDENTIFIER}(?:\.{IDENTIFIER})*))?(?:\+[0-9A-Za-z.-]+)?)?)?"
_COMPARATOR = re.compile(rf"(\^|~>?|[<>]=?|=)?\s*(?:{_PARTIAL})")
_HYPHEN = re.compile(rf"\s*({_PARTIAL})\s+-\s+({_PARTIAL})\s*")
_RELEASE = ((1,),)  # sorts behind every list of pre-release identifiers


def semver_key(version: str) -> tuple | None:
    """A sortable key by semantic precedence; null for what is no version."""
    m = _VERSION.fullmatch(version.strip())
    if not m:
        return None
    return (*map(int, m.group(1, 2, 3)), _pre(m[4]))


def _pre(text: str | None) -> tuple:
    if not text:
        return _RELEASE
    return tuple((0, 0, int(x), "") if x.isdigit() else (0, 1, 0, x) for x in text.split("."))


def _span(operator: str, parts: list[str | None], pre: str | None) -> tuple[tuple, tuple | None, bool, bool] | None:
    """(low, high, low included, high included) of one comparator; high None means no end; None for `nothing`."""
    wild = [p is None or p in "xX*" for p in parts]
    known = wild.index(True) if True in wild else 3
    numbers = [int(p) if i < known else 0 for i, p in enumerate(parts)]
    zero: tuple = ()
    at = (*numbers, _pre(pre) if known == 3 else zero)

    def bumped(i: int) -> tuple:
        return (*[n + 1 if j == i else n if j < i else 0 for j, n in enumerate(numbers)], zero)

    if known == 0:
        return None if operator in ("<", ">") else ((0, 0, 0, zero), None, True, False)
    if operator == ">":
        return (at, None, False, False) if known == 3 else (bumped(known - 1), None, True, False)
    if operator == ">=":
        return at, None, True, False
    if operator == "<":
        return (0, 0, 0, zero), at, True, False
    if operator == "<=":
        return ((0, 0, 0, zero), at, True, True) if known == 3 else ((0, 0, 0, zero), bumped(known - 1), True, False)
    if operator == "^":
        lead = next((i for i in range(known) if numbers[i]), known - 1)
        return at, bumped(lead), True, False
    if operator in ("~", "~>"):
        return at, bumped(min(1, known - 1)), True, False
    return (at, at, True, True) if known == 3 else (at, bumped(known - 1), True, False)


@functools.lru_cache(maxsize=100_000)
def npm_range(text: str) -> tuple | None:
    """Alternatives of spans, with the releases whose pre-releases they name; null for an invalid range."""
    alternatives = []
    for part in text.split("||"):
        spans, named = [], set()
        hyphen = _HYPHEN.fullmatch(part)
        pieces = []
        if hyphen:
            g = hyphen.groups()
            pieces = [(">=", list(g[1:4]), g[4]), ("<=", list(g[6:9]), g[9])]
        else:
            rest = part.strip()
            while rest:
                m = _COMPARATOR.match(rest)
                if not m or (m.end() < len(rest) and not rest[m.end()].isspace()):
                    return None
                pieces.append((m[1] or "", list(m.group(2, 3, 4)), m[5]))
                rest = rest[m.end() :].strip()
        for operator, numbers, pre in pieces:
            span = _span(operator, numbers, pre)
            if span is None:
                spans = None
                break
            spans.append(span)
            if pre:
                named.add(tuple(map(int, numbers)))
        if spans is not None:
            alternatives.append((tuple(spans), frozenset(named)))
    return tuple(alternatives)


def npm_satisfies(version: str | None, text: str | None) -> bool | None:
    """Whether a range admits a version; null if either is invalid. A pre-release must be named by its release."""
    key = semver_key(version) if version is not None else None
    spans = npm_range(text) if text is not None else None
    if key is None or spans is None:
        return None
    for alternative, named in spans:
        if key[3] != _RELEASE and key[:3] not in named:
            continue
        if all((key >= low if low_in else key > low) and (high is None or (key <= high if high_in else key < high)) for low, high, low_in, high_in in alternative):
            return True
    return False


@functools.lru_cache(maxsize=100_000)
def _specifiers(text: str):
    from packaging.specifiers import InvalidSpecifier, SpecifierSet

    try:
        return SpecifierSet(text)
    except InvalidSpecifier:
        return None


def poetry_ranges(text: str) -> list[str]:
    """Caret, tilde and wildcard constraints as plain specifiers; alternatives as several."""
    out = []
    for alternative in re.split(r"\s*\|\|?\s*", text.strip()):
        parts = []
        for item in re.split(r"\s*,\s*|(?<=[\w*])\s+(?=[<>=~^!])", alternative):
            m = re.fullmatch(r"(\^|~)\s*v?(\d+)(?:\.(\d+))?(?:\.(\d+))?(.*)", item)
            if m and not (m[1] == "~" and item.startswith("~=")):
                n = [int(x) for x in m.group(2, 3, 4) if x is not None]
                if m[1] == "^":
                    lead = next((i for i, x in enumerate(n) if x), len(n) - 1)
                else:
                    lead = min(1, len(n) - 1)
                top = ".".join(str(x + (i == lead)) for i, x in enumerate(n[: lead + 1]))
                parts.append(f">={'.'.join(map(str, n))}{m[5]},<{top}")
            elif item in ("*", ""):
                parts.append("")
            elif re.fullmatch(r"v?\d[\w.*+!-]*", item):
                parts.append("==" + item.lstrip("v"))
            else:
                parts.append(item)
        out.append(",".join(p for p in parts if p))
    return out


def pep440_satisfies(version: str | None, text: str | None) -> bool | None:
    from packaging.version import InvalidVersion, Version

    if version is None or text is None:
        return None
    try:
        v = Version(version)
    except InvalidVersion:
        return None
    sets = [_specifiers(x) for x in poetry_ranges(text)]
    return None if None in sets else any(s.contains(v, prereleases=True) for s in sets)


def pep440_order(version: str):
    from packaging.version import InvalidVersion, Version

    try:
        return Version(version)
    except InvalidVersion:
        return None


def _pep440_exact(text: str) -> list[str]:
    return [s.version for x in poetry_ranges(text) for s in _specifiers(x) if s.operator in ("==", "===") and "*" not in s.version and pep440_order(s.version)]


def _npm_exact(text: str) -> list[str]:
    return [v for v in (x.strip().lstrip("=").strip() for x in text.split("||")) if semver_key(v)]


def cargo_as_npm(text: str) -> str:
    """Requirements of a crate: commas mean `and`, a bare version is a caret; alternatives do not exist."""
    pieces = [x.strip() for x in text.split(",")]
    return "?" if "|" in text else " ".join("^" + x if re.match(r"\d+(\.\d+)*([-+].*)?$", x) else x for x in pieces)


def _four(text: str) -> tuple | None:
    return (*map(int, text.split(".")), 0, 0, 0)[:4] if re.fullmatch(NUMERIC[1:-1], text) else None


def nuget_span(text: str) -> tuple | None:
    """(low, high, low included, high included) as in nuget_satisfies; null for what is no range."""
    text = text.strip()
    if _four(text):
        return _four(text), None, True, False
    one = re.fullmatch(r"\[([^,]*)\]", text)
    if one:
        v = _four(one[1].strip())
        return v and (v, v, True, True)
    m = re.fullmatch(r"([\[(])([^,]*),([^,]*)([\])])", text)
    if not m:
        return None
    left, right = m[2].strip(), m[3].strip()
    low, high, low_in, high_in = _four(left), _four(right), m[1] == "[", m[4] == "]"
    broken = (left and not low) or (right and not high) or not (left or right) or (not left and low_in) or (not right and high_in)
    if broken or (low and high and (low > high or (low == high and not (low_in and high_in)))):
        return None
    return low, high, low_in, high_in


def _nuget_admits(version: str, text: str) -> bool:
    v, (low, high, low_in, high_in) = _four(version), nuget_span(text)
    return (low is None or v > low or (low_in and v == low)) and (high is None or v < high or (high_in and v == high))


@dataclass(frozen=True)
class Rules:
    """How an ecosystem reads versions (`order`: null for none) and ranges; `exact`: the versions a range names as only ones."""

    order: Callable
    readable: Callable
    admits: Callable
    exact: Callable
    shown: Callable = str


NPM = Rules(semver_key, lambda r: npm_range(r) is not None, npm_satisfies, _npm_exact)
RULES = {
    "pypi": Rules(pep440_order, lambda r: None not in [_specifiers(x) for x in poetry_ranges(r)], pep440_satisfies, _pep440_exact, lambda v: str(pep440_order(v))),
    "cargo": Rules(
        semver_key, lambda r: npm_range(cargo_as_npm(r)) is not None, lambda v, r: npm_satisfies(v, cargo_as_npm(r)), lambda r: _npm_exact(cargo_as_npm(r)) if "," not in r else []
    ),
    "nuget": Rules(_four, lambda r: nuget_span(r) is not None, _nuget_admits, lambda r: [r.strip()[1:-1].strip()] if "," not in r and r.strip()[:1] == "[" else []),
}


@F.pandas_udf(BooleanType())
def npm_admits(version: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([npm_satisfies(*x) for x in zip(version, text)], dtype=object)


@F.pandas_udf(BooleanType())
def pep440_admits(version: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([pep440_satisfies(*x) for x in zip(version, text)], dtype=object)

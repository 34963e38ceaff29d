"""Licence expressions: canonical form, parse class, and three-valued policy evaluation."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Sequence
from fnmatch import fnmatchcase

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType, StructField, StructType

# The three verdicts and the limits of an expression.
PERMITTED, DENIED, UNDETERMINED = "permitted", "denied", "undetermined"
LONGEST, MOST_OPERATORS, DEEPEST = 16_384, 128, 32


def stated_value(value) -> str | None:
    """Bounded text of a stated licence: blanks collapsed, other JSON shapes as compact JSON."""
    if value is None:
        return None
    text = " ".join(value.split()) if isinstance(value, str) else json.dumps(value, sort_keys=True, separators=(",", ":"))
    return text if text and len(text) <= LONGEST and not re.search(r"[\x00-\x1f\x7f-\x9f]", text) else None


def _within_budget(text: str) -> bool:
    depth = deepest = 0
    for c in text:
        depth += (c == "(") - (c == ")")
        deepest = max(deepest, depth)
    return len(text) <= LONGEST and deepest <= DEEPEST and len(re.findall(r"\b(?:and|or|AND|OR)\b", text)) <= MOST_OPERATORS


@functools.lru_cache(maxsize=1)
def _deprecated() -> frozenset[str]:
    from packaging.licenses._spdx import LICENSES

    return frozenset(v["id"] for v in LICENSES.values() if v["deprecated"])


@functools.lru_cache(maxsize=50_000)
def parsed(raw: str | None) -> tuple[str | None, str]:
    """(canonical expression, class): canonical, deprecated, licenseref or unparsed; never guessed."""
    from packaging.licenses import InvalidLicenseExpression, canonicalize_license_expression

    text = (raw or "").strip()
    if not text or not _within_budget(text):
        return None, "unparsed"
    try:
        expression = str(canonicalize_license_expression(text))
    except InvalidLicenseExpression:
        return None, "unparsed"
    names = [n for n, _ in terms(postfix(expression))]
    if any(n in _deprecated() or n.rstrip("+") in _deprecated() for n in names):
        return expression, "deprecated"
    return expression, "licenseref" if any(n.upper().startswith("LICENSEREF-") for n in names) else "canonical"


Token = tuple[str, str | None] | str


@functools.lru_cache(maxsize=50_000)
def postfix(expression: str) -> tuple[Token, ...]:
    """The expression in postfix order (OR binds loosest): terms as (licence, exception), operators as text."""
    out: list[Token] = []
    stack: list[str] = []
    words = iter(re.findall(r"[()]|[^\s()]+", expression))
    binds = {"OR": 1, "AND": 2}
    for word in words:
        if word == "(":
            stack.append(word)
        elif word == ")":
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif word == "WITH":
            out[-1] = (out[-1][0], next(words))
        elif word in binds:
            while stack and stack[-1] != "(" and binds[stack[-1]] >= binds[word]:
                out.append(stack.pop())
            stack.append(word)
        else:
            out.append((word, None))
    return tuple(out + stack[::-1])


def terms(tokens: Sequence[Token]) -> list[tuple[str, str | None]]:
    return [t for t in tokens if isinstance(t, tuple)]


def _combine(operator: str, a: str, b: str) -> str:
    decisive, other = (PERMITTED, DENIED) if operator == "OR" else (DENIED, PERMITTED)
    if decisive in (a, b):
        return decisive
    return other if a == b == other else UNDETERMINED


class LicensePolicy:
    """Allowed and denied licences; globs are allowed for plain licences, pairs with an exception are exact."""

    def __init__(self, allowed: Sequence[str] = (), denied: Sequence[str] = ()):
        self.allowed, self.denied = [self._entry(e) for e in allowed], [self._entry(e) for e in denied]

    @staticmethod
    def _entry(entry: str) -> str:
        text = " ".join(entry.upper().split())
        words = text.split()
        if not words or set("()") & set(text) or {"AND", "OR"} & set(words):
            raise ValueError(f"a policy lists licences, not expressions: {entry!r}")
        if "WITH" in words and (words.count("WITH") > 1 or words[0] == "WITH" or words[-1] == "WITH" or set("*?[") & set(text)):
            raise ValueError(f"no licence or exact pair: {entry!r}")
        return text

    def term(self, licence: str, exception: str | None) -> str:
        name = licence.upper()
        pair = name if exception is None else f"{name} WITH {exception.upper()}"
        fits = lambda entries: any(" WITH " not in e and not e.startswith("LICENSEREF-") and fnmatchcase(name, e) for e in entries)
        if exception and pair in self.allowed:
            return PERMITTED
        if name.startswith("LICENSEREF-"):
            return DENIED if pair in self.denied or name in self.denied else PERMITTED if name in self.allowed else UNDETERMINED
        if pair in self.denied or fits(self.denied):
            return DENIED
        return PERMITTED if fits(self.allowed) or not self.allowed else UNDETERMINED

    def verdict(self, raw: str | None) -> str:
        expression, _ = parsed(raw)
        if expression is None:
            return UNDETERMINED
        stack: list[str] = []
        for token in postfix(expression):
            stack.append(self.term(*token) if isinstance(token, tuple) else _combine(token, stack.pop(), stack.pop()))
        return stack.pop()


_PARSED = StructType([StructField("expression", StringType()), StructField("parse", StringType())])


@F.pandas_udf(_PARSED)
def parse_license(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parsed(x) for x in raw], columns=["expression", "parse"])


def evaluated(raw: Column, policy: LicensePolicy) -> Column:
    """permitted, denied or undetermined. Three strings, never null: the logic is not SQL's."""

    @F.pandas_udf(StringType())
    def verdicts(values: pd.Series) -> pd.Series:
        known: dict[str | None, str] = {}
        return pd.Series([known[v] if v in known else known.setdefault(v, policy.verdict(v)) for v in values], dtype=object)

    return verdicts(raw)


def strictest(results: Column) -> Callable:
    """Verdict of several observations: any denied, else all permitted, else undetermined."""
    return (
        F.when(F.bool_or(results == DENIED), DENIED).when(F.bool_and(results == PERMITTED), PERMITTED).otherwise(UNDETERMINED)
    )


def composer_license(names: Column) -> Column:
    """A list of licences as one expression: alternatives joined by OR, compound ones in brackets."""
    wrapped = F.transform(names, lambda x: F.when((F.size(names) > 1) & x.rlike(r"\s"), F.concat(F.lit("("), x, F.lit(")"))).otherwise(x))
    return F.nullif(F.array_join(wrapped, " OR "), F.lit(""))

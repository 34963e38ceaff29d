"""Environment markers: three-valued activation and provable disjointness."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

LONGEST, DEEPEST = 16_384, 32


@functools.lru_cache(maxsize=20_000)
def _tree(expression: str):
    """The marker's tree and its variables; None if it is no marker that compares variables with values."""
    from packaging.markers import InvalidMarker, Marker

    if not expression or len(expression) > LONGEST or re.search(r"[\x00-\x1f\x7f-\x9f]", expression):
        return None
    bare = re.sub(r"'[^']*'|\"[^\"]*\"", "", expression)
    if bare.count("(") > DEEPEST * 8:
        return None
    try:
        tree = Marker(expression)._markers
    except (InvalidMarker, ValueError, RecursionError):
        return None
    variables, stack = set(), [tree]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack.extend(node)
        elif isinstance(node, tuple):
            sides = [x for x in (node[0], node[2]) if type(x).__name__ == "Variable"]
            if len(sides) != 1:
                return None
            variables.add(sides[0].value)
    return tree, frozenset(variables)


def activation(expression: str | None, environment: dict[str, str]) -> str:
    """active, inactive or unknown. Unknown if any variable it uses is missing, even where it would not matter."""
    from packaging.markers import UndefinedComparison, UndefinedEnvironmentName, _evaluate_markers

    if expression is None:
        return "active"
    known = _tree(expression)
    if known is None or not known[1] <= set(environment):
        return "unknown"
    try:
        return "active" if _evaluate_markers(known[0], environment) else "inactive"
    except (UndefinedComparison, UndefinedEnvironmentName, ValueError, RecursionError):
        return "unknown"


def conjunction(expression: str | None) -> tuple | None:
    """Sorted (variable, operator, value) of a flat AND with the variables on the left; None for any other."""
    if expression is None:
        return ()
    known = _tree(expression)
    if known is None:
        return None
    tree, atoms = known[0], []
    for i, node in enumerate(tree):
        if i % 2:
            if node != "and":
                return None
        elif isinstance(node, tuple) and type(node[0]).__name__ == "Variable":
            atoms.append((node[0].value, node[1].value, node[2].value))
        else:
            return None
    return tuple(sorted(atoms))


OPPOSITES = [{"==", "!="}]
VERSION_OPPOSITES = [{"<", ">="}, {"<=", ">"}]


def disjoint(left: str | None, right: str | None) -> bool:
    """Only what is provable: two conjunctions that demand opposite things of one variable."""
    a, b = conjunction(left), conjunction(right)
    for variable, operator, value in a or ():
        for other, against, same in b or ():
            if (variable, value) != (other, same):
                continue
            numeric = variable in ("python_version", "python_full_version") and re.fullmatch(r"[0-9]+(\.[0-9]+)*", value)
            if {operator, against} in OPPOSITES or (numeric and {operator, against} in VERSION_OPPOSITES):
                return True
    return False


def marker_activation(marker: Column, environment: dict[str, str]) -> Column:
    @F.pandas_udf(StringType())
    def active(values: pd.Series) -> pd.Series:
        return pd.Series([activation(v, environment) for v in values], dtype=object)

    return active(marker)

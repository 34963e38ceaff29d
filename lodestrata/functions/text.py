"""Column expressions for cleaning keys; all stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What counts as white space at the ends of a value.
BLANKS = " \t\r\n\x0b\x0c"


def trimmed(c: Column | str) -> Column:
    """Without blanks, tabs and line ends at both ends; null stays null."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))


def key(c: Column | str) -> Column:
    """Trimmed and in lower case; empty becomes null, so that it joins nothing."""
    return F.nullif(F.lower(trimmed(c)), F.lit(""))


def stable_columns(df, *names: str):
    """The named columns only: extra columns of an input can then never clash with an operator's own."""
    return df.select(*[df[n] for n in names])

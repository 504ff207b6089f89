"""String helpers shared by all operators."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# what a text strip removes at both ends (ASCII white space)
WHITE_SPACE = " \t\r\n\x0b\x0c"


def any_of(tests: Iterable[Column]) -> Column:
    """OR over the tests; false when there are none."""
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def first_truthy(*cols: Column, default: str | None = "") -> Column:
    """First value that is neither null nor empty, else ``default``."""
    return F.coalesce(*[F.when(c != "", c) for c in cols], F.lit(default).cast("string"))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True when ``text`` holds one of ``words``: one alternation, one expression per word list."""
    if len(words) == 1:
        return F.contains(text, F.lit(words[0]))
    return F.rlike(text, F.lit("|".join(re.escape(w) for w in words)))


def starts_with_any(text: Column, prefixes: Sequence[str]) -> Column:
    return F.rlike(text, F.lit("^(?:" + "|".join(re.escape(p) for p in prefixes) + ")"))


def strip(text: Column) -> Column:
    """Remove white space (tabs and line ends too) at both ends."""
    return F.trim(text, F.lit(WHITE_SPACE))


def choose(pairs: Iterable[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """Ordered CASE: the value of the first test that holds."""
    out = None
    for test, value in pairs:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out if otherwise is None else out.otherwise(otherwise)


def lookup(key: Column, table: dict, otherwise: Column | None = None) -> Column:
    """CASE over a small literal table."""
    return choose(((key == F.lit(k), F.lit(v)) for k, v in table.items()), otherwise)


def computed_once(df: DataFrame, name: str, expression: Column) -> DataFrame:
    """Add a costly column that later filters read without computing it again.

    A filter is pushed below a projection by copying the projected expression into it, so a
    parse would run twice per row. A filter on the output of a generator stays above it.
    """
    return df.select("*", F.explode(F.array(expression)).alias(name))

"""Small Column helpers shared by the function modules."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\x0b\f\r\x85\xa0"


def as_col(value) -> Column:
    """A Column from a column name or a Column."""
    return value if isinstance(value, Column) else F.col(value)


def bind(expr: Column, body: Callable[[Column], Column]) -> Column:
    """``body(expr)`` with ``expr`` evaluated once, however often ``body`` uses it."""
    return F.transform(F.array(expr), body).getItem(0)


def int_div(a: Column, b) -> Column:
    """Whole-number division (truncating)."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def to_int(text: Column) -> Column:
    """Digits to INT, NULL when the text is no number."""
    return text.try_cast("int")


def digits(text: Column, start: int, length: int) -> Column:
    return to_int(F.substring(text, start, length))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """First regex match, NULL (not '') when there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def trim_space(text: Column) -> Column:
    """Strip every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def fixed_point(number: Column, decimals: int) -> Column:
    """``%.Nf`` of the exact binary value, ties to even (``format_string`` rounds the
    shortest decimal form up instead)."""
    return F.translate(F.format_number(number, decimals), ",", "")


def built_once(fn: Callable) -> Callable:
    """Keep the Columns a function builds, per JVM and (hashable) arguments. A Column
    over column names is not tied to a table, and a large one takes a while to build."""
    known: dict = {}

    @functools.wraps(fn)
    def cached(*args):
        key = (id(SparkContext._gateway), args)
        if key not in known:
            known[key] = fn(*args)
        return known[key]

    return cached

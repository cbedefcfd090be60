"""Number parsing and row-wise arithmetic as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_decimal_comma(text: Column) -> Column:
    """`1.234,56` to 1234.56; text that is no number becomes null."""
    return F.translate(text, ",.", ".").try_cast("double")


def format_decimal_comma(value: Column, digits: int = 2) -> Column:
    return F.translate(F.format_number(value, digits), ",.", ".,")


def row_sum(*cols: Column) -> Column:
    return reduce(add, cols)


def row_mean(*cols: Column) -> Column:
    return row_sum(*cols) / F.lit(len(cols))


def null_if_nan(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def level_name(prefix: str, tau: float) -> str:
    """Column name of one quantile level, `q0_025` for prefix `q` and level .025."""
    return prefix + f"{tau:g}".replace(".", "_")

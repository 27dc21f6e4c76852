"""Price and quantity expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import ColumnOrName, col

MONEY = "decimal(12,2)"


def _number(c: Column) -> Column:
    return c.try_cast("decimal(20,6)")


def parse_price(c: ColumnOrName) -> Column:
    """A price in Brazilian or English form; null if it is none or not above zero."""
    s = F.regexp_replace(F.translate(col(c), V.ACCENTED, V.BARE), r"[^0-9.,\-]", "")
    # bound as an element of an array, so that it is worked out once a row
    return F.get(F.transform(F.array(s), _price_of), F.lit(0))


def _price_of(s: Column) -> Column:
    commas, points = (F.length(s) - F.length(F.translate(s, mark, "")) for mark in (",", "."))
    first, last = F.regexp_instr(s, F.lit("[.,]")), F.length(s) - F.regexp_instr(F.reverse(s), F.lit("[.,]")) + 1
    head, tail = F.substring(s, F.lit(1), first - 1), F.substring(s, last + 1, F.length(s))
    plain = F.translate(s, ",.", "")
    as_comma = F.translate(F.translate(s, ".", ""), ",", ".")
    thousands = (F.length(tail) == 3) & head.rlike("^[0-9]+$")
    value = (
        F.when((commas > 0) & (points > 0), F.when(F.substring(s, last, F.lit(1)) == ",", as_comma).otherwise(F.translate(s, ",", "")))
        .when(commas == 1, F.when(thousands, plain).otherwise(as_comma))
        .when(commas > 1, F.concat(F.translate(F.substring(s, F.lit(1), last - 1), ",", ""), F.lit("."), tail))
        .when(points == 1, F.when(thousands & head.rlike("[1-9]"), plain).otherwise(s))
        .when(points > 1, plain)
        .otherwise(s)
    )
    return F.get(F.filter(F.array(_number(value)), lambda v: v > 0), F.lit(0))


def is_valid_cost(c: ColumnOrName) -> Column:
    """From 0.01 to 999999; false for null."""
    return F.coalesce(col(c).between(F.lit("0.01").cast("decimal(20,6)"), F.lit(999999)), F.lit(False))


def parse_feed_price(c: ColumnOrName) -> Column:
    """A feed's price: with a comma Brazilian, else a plain decimal; two places, half even."""
    s = F.regexp_replace(col(c).cast("string"), r"[R$\s]", "")
    return F.bround(_number(F.when(s.contains(","), F.translate(F.translate(s, ".", ""), ",", ".")).otherwise(s)), 2).cast(MONEY)


def parse_page_price(c: ColumnOrName) -> Column:
    """A page's price: points are thousands; 0 if it is none."""
    s = F.regexp_replace(col(c), r"[R$\s]", "")
    return F.coalesce(_number(F.translate(F.translate(s, ".", ""), ",", ".")).cast(MONEY), F.lit(0).cast(MONEY))


def parse_sold(c: ColumnOrName) -> Column:
    """P5: a sold count: N mil is N thousand, else the first number, else 0."""
    s = F.lower(F.translate(col(c), ".,", ""))
    thousands, first = F.regexp_extract(s, r"(\d+)\s*mil", 1), F.regexp_extract(s, r"(\d+)", 1)
    return F.coalesce(F.when(thousands != "", thousands.try_cast("long") * 1000).when(first != "", first.try_cast("long")), F.lit(0).cast("long"))


def units_per_package(c: ColumnOrName) -> Column:
    """Units that a package name states; 1 if none, or if it is a dimension."""
    group = lambda k: F.nullif(F.regexp_extract(col(c), V.UNITS_PER_PACKAGE, k), F.lit(""))
    units = F.coalesce(*[group(k) for k in range(1, 9)]).try_cast("long")
    return F.when(units.between(1, V.MOST_UNITS), units).otherwise(F.lit(1)).cast("int")


def unit_cost(cost: ColumnOrName, name: ColumnOrName) -> Column:
    """A lot's cost by its units, half up; null for a cost beyond the type of money."""
    return F.round(F.round(col(cost), 2).try_cast(MONEY) / units_per_package(name), 2).cast(MONEY)

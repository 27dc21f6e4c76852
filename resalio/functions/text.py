"""Text expressions over names, titles and headers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def one_of(words) -> Column:
    return F.array(*[F.lit(w) for w in dict.fromkeys(words)])


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_accents(c: ColumnOrName) -> Column:
    return F.regexp_replace(F.translate(col(c), V.ACCENTED, V.BARE), r"\p{M}", "")


def norm_header(c: ColumnOrName) -> Column:
    """No accents, lower case, single spaces."""
    return squeeze(F.lower(strip_accents(c)))


def norm_match(c: ColumnOrName) -> Column:
    """The form in which names and titles are compared; null is empty."""
    x = F.lower(strip_accents(F.coalesce(col(c), F.lit(""))))
    x = F.regexp_replace(x, r"(\d)(ml|kg|g|w|v|cm|mm|m|l)(?=\s|$)", "$1 $2")
    x = F.regexp_replace(x, r"(\b\d+)\s+l\b", "$1 litro")
    x = F.regexp_replace(x, r"[^a-z0-9\s]", " ")
    return squeeze(reduce(lambda y, s: F.regexp_replace(y, *s), V.SYNONYMS, x))


def digits(c: Column) -> Column:
    return c.rlike("^[0-9]+$")


def tokens_of(norm: ColumnOrName) -> Column:
    """T4, T5 on a normalised text: tokens that carry meaning, in order, high-weight plurals in the singular."""

    def kept(t: Column) -> Column:
        short = (F.length(t) == 1) & ~t.isin(V.SIZES) & ~digits(t)
        large = digits(t) & (F.length(F.regexp_replace(t, "^0+", "")) > 3)
        return (t != "") & ~t.isin(V.STOP_WORDS) & ~short & ~large

    def singular(t: Column) -> Column:
        base = F.substring(t, F.lit(1), F.length(t) - 1)
        return F.when((F.length(t) > 4) & t.endswith("s") & ~t.endswith("ss") & base.isin(V.HIGH_WEIGHT), base).otherwise(t)

    return F.transform(F.filter(F.split(col(norm), " "), kept), singular)


def tokens(c: ColumnOrName) -> Column:
    """T4: tokens of a raw text."""
    return tokens_of(norm_match(c))


def clean_text(c: ColumnOrName) -> Column:
    """Single spaces; null for cells that say nothing."""
    x = squeeze(col(c))
    return F.when((x != "") & ~F.lower(x).isin(V.EMPTY_CELLS), x)


def clean_sku(c: ColumnOrName, numeric: ColumnOrName | bool = False) -> Column:
    """Numeric cells without a zero fraction; others as text."""
    is_number = F.lit(numeric) if isinstance(numeric, bool) else F.coalesce(col(numeric), F.lit(False))
    return clean_text(F.when(is_number, F.regexp_replace(col(c), r"\.0+$", "")).otherwise(col(c)))


def without_code(c: ColumnOrName) -> Column:
    """A name without an internal code before it, if anything is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(col(c), V.INTERNAL_CODE, "")), F.lit("")), col(c))


def without_packaging(norm: ColumnOrName) -> Column:
    """No wholesale packaging."""
    return squeeze(F.regexp_replace(col(norm), V.PACKAGING, " "))


def search_query(c: ColumnOrName) -> Column:
    """At most six tokens to search a name by, else its first three words."""
    name = without_code(c)
    found = tokens_of(without_packaging(norm_match(name)))
    suffix = one_of(V.QUANTITY_SUFFIXES)

    def kept(t: Column, i: Column) -> Column:
        after, before = F.get(found, i + 1), F.get(found, i - 1)
        opens = digits(t) & F.coalesce(F.array_contains(suffix, after), F.lit(False))
        closes = F.array_contains(suffix, t) & F.coalesce(digits(before), F.lit(False))
        return ~opens & ~closes

    query = F.array_join(F.slice(F.filter(found, kept), 1, 6), " ")
    return F.coalesce(F.nullif(query, F.lit("")), F.array_join(F.slice(F.split(squeeze(name), " "), 1, 3), " "))


def item_id(url: ColumnOrName) -> Column:
    """An item's id from its address; null where there is none."""
    number = F.regexp_extract(col(url), r"(?i)MLB-?(\d+)", 1)
    return F.when(number != "", F.concat(F.lit("MLB"), number))


def simplify_query(c: ColumnOrName) -> Column:
    """The first three words."""
    words = F.split(squeeze(col(c)), " ")
    return F.when(F.size(words) > 3, F.array_join(F.slice(words, 1, 3), " ")).otherwise(col(c))


def told(c: ColumnOrName) -> Column:
    x = F.trim(col(c))
    return F.when(~F.lower(x).isin("nan", "none", ""), x)


def precision_name(query: ColumnOrName, brand: ColumnOrName, model: ColumnOrName) -> Column:
    """An exact name to search by: the query column, brand and model, model alone, or null."""
    return F.coalesce(told(query), F.when(told(model).isNotNull(), F.concat_ws(" ", told(brand), told(model))))


def search_name(normalized: ColumnOrName, raw: ColumnOrName) -> Column:
    """The normalised name unless it is null or empty."""
    return F.coalesce(F.nullif(col(normalized), F.lit("")), col(raw))


def query_slug(c: ColumnOrName) -> Column:
    """A query as part of an address."""
    bare = F.regexp_replace(F.lower(F.trim(col(c))), r"[^\p{L}\p{N}_\s-]", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[\s_]+", "-"), "^-+|-+$", "")


def format_brl(c: ColumnOrName) -> Column:
    """R$ 1.234,56."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(col(c).cast("decimal(18,2)"), 2), ",.", ".,"))


def format_pct(c: ColumnOrName) -> Column:
    """12,3%."""
    return F.concat(F.translate(F.format_number(col(c).cast("decimal(18,1)"), 1), ",.", ".,"), F.lit("%"))


def logistic_label(c: ColumnOrName) -> Column:
    """How a listing is shipped, as shown; other values as they are."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in V.LOGISTIC_LABELS.items() for x in kv])[col(c)], col(c))


def status_label(c: ColumnOrName) -> Column:
    """A catalog's status, as shown; other values as they are."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in V.STATUS_LABELS.items() for x in kv])[col(c)], col(c))

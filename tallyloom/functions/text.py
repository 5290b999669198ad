"""Column expressions for messy text: trimming, name matching, and tests of what a value looks like."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.fixed import DATE_FORMATS, EMAIL, RULE_DATES, TYPE_AMOUNT, TYPE_EMAIL, TYPE_PHONE


_LOW = "".join(map(chr, range(0x21)))
_SPACE = " \t\n\x0b\f\r"


def full(value: Column, pattern: str) -> Column:
    """Whether the whole value matches; a final line break doesn't slip through."""
    return value.rlike(f"\\A(?:{pattern})\\z")


def trim(value: Column) -> Column:
    """Without leading and trailing characters up to U+0020 (plain trim takes spaces only)."""
    return F.trim(value, F.lit(_LOW))


def is_blank(value: Column) -> Column:
    # what begins with more than a space is not trimmed to see it
    return value.isNull() | ((value < "!") & (F.trim(value, F.lit(_SPACE)) == ""))


def changed_keys(payload: str, change: Callable[[Column], Column]) -> Column:
    """The keys of a map, each changed by a function of text that neither makes nor removes line breaks: all at once as one text, and one by one where a key has
    a line break."""
    keys = F.map_keys(payload)
    parts = F.split(change(F.array_join(keys, "\n")), "\n", -1)
    return F.when(F.size(parts) == F.size(keys), parts).otherwise(F.transform(keys, change))


def norm_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def name_tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(name), "[ _]+"), lambda t: t != ""))


def is_integer(value: Column) -> Column:
    """32-bit whole number without leading zeros ("0" is one, "05" not)."""
    return full(value, "[+-]?[0-9]+") & ~full(value, "-?0[0-9]+") & value.try_cast("int").isNotNull()


def is_decimal(value: Column) -> Column:
    """Any precision, exponents too; a leading zero only before the point."""
    return full(value, "[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?") & ~full(value, "-?0[^.].*")


def is_boolean(value: Column) -> Column:
    return F.lower(value).isin("true", "false")


def is_datetime(value: Column) -> Column:
    return full(value, "[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\\.[0-9]{1,9})?)?(Z|[+-][0-9]{2}:[0-9]{2}(\\[.+\\])?)?")


def is_email(value: Column) -> Column:
    return full(value, TYPE_EMAIL)


def is_phone(value: Column) -> Column:
    return full(value, TYPE_PHONE)


def is_currency_amount(value: Column) -> Column:
    return full(value, TYPE_AMOUNT)


def matches_format(value: Column, pattern: str) -> Column:
    return full(value, dict(DATE_FORMATS)[pattern])


def is_rule_date(value: Column) -> Column:
    """A date as the validity rule reads it: days up to 31 in any month."""
    return full(value, "|".join(RULE_DATES))


def iso_date(value: Column) -> Column:
    """The date of a strict yyyy-MM-dd, else null."""
    return F.when(full(value, "[0-9]{4}-[0-9]{2}-[0-9]{2}"), value.try_cast("date"))


def is_rule_email(value: Column) -> Column:
    return full(value, EMAIL)


def first_present(payload, names: list[str]) -> Column:
    """The first of several fields (of a map column, or whatever gives columns by name) that is not blank."""
    return F.coalesce(*[F.when(~is_blank(payload[n]), payload[n]) for n in names])

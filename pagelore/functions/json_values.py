"""Reading untrusted JSON replies without ever failing the job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(reply: Column) -> Column:
    """The reply as VARIANT, NULL when it is not valid JSON."""
    return F.try_parse_json(reply)


def kind_of_text(raw: Column) -> Column:
    """``OBJECT``, ``ARRAY``, ``STRING``, ``BOOLEAN``, ``VOID`` or ``NUMBER``, told by
    the first letter of a JSON text; NULL when absent."""
    first = F.left(raw, F.lit(1))
    return (
        F.when(first == "{", "OBJECT").when(first == "[", "ARRAY").when(first == '"', "STRING")
        .when(first.isin("t", "f"), "BOOLEAN").when(first == "n", "VOID")
        .when(first.isNotNull(), "NUMBER")
    )


def kind(value: Column) -> Column:
    """:func:`kind_of_text` of a value."""
    return kind_of_text(F.to_json(value))


def member(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def truthy_text(raw: Column) -> Column:
    """Whether a value, by its JSON text, counts as true: not null, false, zero or empty."""
    empty = raw.isNull() | raw.isin("null", "false", '""', "[]", "{}")
    zero = (F.left(raw, F.lit(1)) != '"') & (raw.try_cast("double") == 0)
    return ~empty & ~F.coalesce(zero, F.lit(False))


def whole_number(value: Column) -> Column:
    """Whole-number reading as DOUBLE: numbers are cut toward zero, texts must
    spell an integer, anything else is NULL."""
    as_text = value.cast("string")
    of_text = F.when(
        as_text.rlike(r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"),
        F.replace(F.trim(as_text), F.lit("_"), F.lit("")).try_cast("double"),
    )
    number = as_text.try_cast("double")
    cut = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("double")
    name = kind(value)
    return (
        F.when(name == "STRING", of_text)
        .when(name == "BOOLEAN", F.when(as_text == "true", 1.0).otherwise(0.0))
        .when(name == "NUMBER", cut)
    )

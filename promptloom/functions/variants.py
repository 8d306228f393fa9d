"""Column helpers for VARIANT values (parsed JSON of unknown shape)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``, also inside conditions."""
    return F.transform(F.array(value), body)[0]


def parse(text: Column) -> Column:
    """JSON text as VARIANT, null when it is not exactly one JSON value.

    The built-in parser ignores what follows the first value. Inside brackets the rest of the text is
    seen as well; a text that could close the brackets itself cannot close braces too, so it is tried in both.
    Give the result of a Python function a column of its own before parsing it.
    """
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    braced = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return let(listed, lambda values: F.when((F.size(values) == 1) & braced.isNotNull(), values[0]))


def get(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def as_object(value: Column) -> Column:
    """Fields of a JSON object, null for every other kind of value."""
    return get(value, "$", "map<string,variant>")


def is_object(value: Column) -> Column:
    """Whether a value is a JSON object; looks at none of its fields."""
    return F.try_variant_get(value, "$", "struct<__any: variant>").isNotNull()


def field(value: Column, name: str | Column) -> Column:
    """The field of an object with exactly this name, dots and all."""
    return as_object(value)[name if isinstance(name, Column) else F.lit(name)]


def as_array(value: Column) -> Column:
    """Elements of a JSON array, null for every other kind of value."""
    return get(value, "$", "array<variant>")


def text_of(value: Column) -> Column:
    """A string as it is, anything else as JSON text; null for null."""
    return get(value, "$", "string")


def whole_text(value: Column) -> Column:
    """Like ``text_of`` but JSON null becomes the text ``null``."""
    return F.coalesce(text_of(value), F.to_json(value))


def is_falsy(value: Column) -> Column:
    """Missing, null, empty string, zero, false, or an empty container."""
    text = text_of(value)
    short = F.when(F.length(text) <= 5, F.to_json(value).isin('""', "0", "0.0", "false", "[]", "{}"))
    return text.isNull() | F.coalesce(short, F.lit(False))


def as_variant(value: Column) -> Column:
    return value.cast("variant")

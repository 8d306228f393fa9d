"""Prompt records of any shape: finding the user text and system text, building request bodies."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions import variants as V

# Fixed values of the request format.
DEFAULT_SYSTEM = "You are a helpful assistant"
DEFAULT_TARGET_LANGUAGE = "EN-US"
CHAT_ENDPOINT = "/v1/chat/completions"
COMPLETION_WINDOW = "24h"
EMPTY_PROMPTS = "Empty prompts list"


def normalize_prompt(value: Column, prompt_key: str) -> Column:
    """Lenient user text: a string, the prompt field, the only field, or the whole item as JSON."""
    return V.let(V.as_object(value), lambda fields: (
        F.when(F.map_contains_key(fields, prompt_key), V.text_of(fields[prompt_key]))
        .when(F.size(fields) == 1, V.text_of(F.map_values(fields)[0]))
        .otherwise(V.whole_text(value))))


def _holder(value: Column) -> Column:
    """Where the fields are: the first entry of ``prompts`` when that is a list, else the item itself.

    A struct, so that an empty list (``empty``) and a list whose first entry is no object can be told apart.
    """
    return V.let(V.as_array(V.get(value, "$.prompts", "variant")), lambda nested: F.struct(
        F.when(nested.isNotNull(), F.get(nested, F.lit(0))).otherwise(value).alias("at"),
        F.coalesce(F.size(nested) == 0, F.lit(False)).alias("empty")))


def _strict(value: Column, key: str | Column, message: str | Column, found: Callable[[Column, Column, Column], Column]) -> Column:
    """Call ``found`` with the holder, the field's text and the error of a required field."""
    def check(holder: Column, field: Column) -> Column:
        error = F.when(holder["empty"], F.lit(EMPTY_PROMPTS)).when(V.is_falsy(field), message if isinstance(message, Column) else F.lit(message))
        return V.let(F.struct(V.text_of(field).alias("text"), error.alias("error")),
                     lambda r: found(holder["at"], F.when(r["error"].isNull(), r["text"]), r["error"]))
    return V.let(_holder(value), lambda holder: V.let(
        V.field(holder["at"], key), lambda field: check(holder, field)))


def find_prompt(value: Column, prompt_key: str | Column, system_key: str | Column, is_dynamic: bool | Column) -> Column:
    """Strict lookup: struct of ``user``, ``system`` and ``error`` (null when the prompt is there).

    Field names are names, not paths, and may differ from row to row, as settings joined by ``join_config`` do.
    """
    def found(at: Column, user: Column, error: Column) -> Column:
        system = select_system(V.text_of(V.field(at, system_key)), is_dynamic)
        return F.struct(user.alias("user"), F.when(error.isNull(), system).alias("system"), error.alias("error"))
    name = prompt_key if isinstance(prompt_key, Column) else F.lit(prompt_key)
    message = F.concat(F.lit("Required prompt field '"), name, F.lit("' not found in input"))
    return _strict(value, name, message, found)


def find_text(value: Column) -> Column:
    """Strict text for translation: struct of ``text`` and ``error``."""
    return _strict(value, "text", "Required 'text' field not found in input",
                   lambda _, text, error: F.struct(text.alias("text"), error.alias("error")))


def select_system(system: Column, is_dynamic: bool | Column, default: str = DEFAULT_SYSTEM) -> Column:
    """The row's own system text when dynamic and not empty, else the default."""
    dynamic = is_dynamic if isinstance(is_dynamic, Column) else F.lit(is_dynamic)
    return F.when(dynamic, F.coalesce(F.nullif(system, F.lit("")), F.lit(default))).otherwise(default)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def build_chat_body(user: Column, system: Column, model: Column, temperature: Column,
                    max_tokens: Column) -> Column:
    return F.struct(
        model.alias("model"),
        F.array(message("system", system), message("user", user)).alias("messages"),
        temperature.alias("temperature"),
        max_tokens.alias("max_tokens"),
    )


def build_translate_body(text: Column, target: Column, source: Column,
                         configured: str = DEFAULT_TARGET_LANGUAGE) -> Column:
    return F.struct(text.alias("text"), F.coalesce(target, F.lit(configured)).alias("target_lang"),
                    source.alias("source_lang"))


def build_translate_array_body(text: Column, target: Column) -> Column:
    """Struct of ``body`` (one-element text list, upper-case language) and ``error``."""
    bad = F.coalesce(text, F.lit("")).isin("") | F.coalesce(target, F.lit("")).isin("")
    body = F.struct(F.array(text).alias("text"), F.upper(target).alias("target_lang"))
    return F.struct(F.when(~bad, body).alias("body"),
                    F.when(bad, F.lit("Missing translation text or target_lang")).alias("error"))


def build_body(service: Column, chat: Column, translate: Column) -> Column:
    """JSON body for the row's service; a service nobody serves gives an error."""
    return F.struct(
        F.when(service.isin("openai", "deepseek"), F.to_json(chat))
        .when(service == "deepl", F.to_json(translate)).alias("body"),
        F.when(~F.coalesce(service.isin("openai", "deepseek", "deepl"), F.lit(False)),
               F.concat(F.lit("Unsupported service: "), F.coalesce(service, F.lit("null")))).alias("error"),
    )


def flatten_prompts(value: Column) -> Column:
    """The item with every field kept and non-object entries of ``prompts`` dropped, as VARIANT."""
    fields = V.as_object(value)

    def keep_objects(key: Column, field: Column) -> Column:
        entries = V.as_array(field)
        objects = F.filter(entries, lambda e: V.as_object(e).isNotNull())
        return F.when((key == "prompts") & entries.isNotNull(), V.as_variant(objects)).otherwise(field)

    return F.when(fields.isNotNull(),
                  F.to_variant_object(F.transform_values(fields, keep_objects))).otherwise(value)


def explode_prompts(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """One row per object entry of ``prompts`` with its 0-based place ``prompt_idx``."""
    entries = V.as_array(V.get(F.col(column), "$.prompts", "variant"))
    objects = F.filter(entries, lambda e: V.as_object(e).isNotNull())
    return df.select(*keep, F.posexplode(objects).alias("prompt_idx", "prompt"))


def filter_blank(df: DataFrame, column: str) -> DataFrame:
    """Drop rows whose text is null, empty or only white space."""
    return df.where(F.trim(F.regexp_replace(column, r"\s", " ")) != "")


def drop_nulls(record: Column) -> Column:
    """JSON of a struct without its null fields."""
    return F.to_json(record, {"ignoreNullFields": "true"})

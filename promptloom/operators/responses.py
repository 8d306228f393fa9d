"""Answers of any shape, and matching them with their inputs."""
from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions import names as N
from promptloom.functions import variants as V
from promptloom.functions.times import epoch_micros
from promptloom.operators import joins
from promptloom.sources.documents import Cutter

# Fixed values of the response format.
INPUT_NOT_FOUND = "Error: Input data not found"
BATCH_FAILURE = "Batch job failed"
NO_CONTENT = "Error formatting response"


def extract_content(value: Column) -> Column:
    """Answer text, trying the known shapes from the most to the least specific.

    An item with a ``choices`` list but no usable first choice has no content (null).
    """
    has_choices = V.as_array(V.get(value, "$.choices", "variant")).isNotNull()
    fields = V.as_object(value)
    lines = F.transform(V.as_array(value), V.whole_text)
    return F.coalesce(
        V.get(value, "$.response.body.choices[0].message.content"),
        V.get(value, "$.choices[0].message.content"),
        F.when(~has_choices & fields.isNotNull(),
               F.when(F.map_contains_key(fields, "content"), V.get(value, "$.content"))
               .otherwise(V.text_of(value))),
        F.when(lines.isNotNull(), F.array_join(lines, "\n")),
        F.when(fields.isNull(), V.whole_text(value)),
    )


def extract_translation(value: Column) -> Column:
    """Struct of ``translated_text`` and ``detected_source_lang``, also from the provider's own form."""
    return F.struct(
        F.coalesce(V.get(value, "$.translated_text"), V.get(value, "$.translations[0].text"),
                   V.get(value, "$.text")).alias("translated_text"),
        F.coalesce(V.get(value, "$.detected_source_lang"),
                   V.get(value, "$.translations[0].detected_source_language"),
                   V.get(value, "$.translations[0].detected_source_lang")).alias("detected_source_lang"),
    )


def _wrapped(content: Column) -> Column:
    return F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices"))


def normalize_response(text: Column) -> Column:
    """An object stays as it is; any other text is wrapped as the only choice. Result is VARIANT."""
    parsed = V.parse(text)
    return F.when(V.as_object(parsed).isNotNull(), parsed).otherwise(F.to_variant_object(_wrapped(text)))


def is_batch_failure(content: Column) -> Column:
    return F.coalesce(F.startswith(content, F.lit(BATCH_FAILURE)), F.lit(False))


def mark_errors(df: DataFrame, content: str, error: str = "error") -> DataFrame:
    """Add an error text to rows without content, instead of failing the job."""
    return df.withColumn(error, F.when(F.col(content).isNull(), F.lit(NO_CONTENT)))


def result_envelope(input_: Column, response: Column, started: Column, finished: Column) -> Column:
    seconds = (epoch_micros(finished) - epoch_micros(started)) / F.lit(1e6)
    return F.struct(input_.alias("input"), response.alias("response"), finished.alias("timestamp"),
                    seconds.alias("duration"))


def align_inner(inputs: DataFrame, responses: DataFrame, on: Sequence[str]) -> DataFrame:
    """i-th input with i-th response of the same file; the shorter side decides."""
    return inputs.join(responses, list(on), "inner")


def align_left(responses: DataFrame, inputs: DataFrame, on: Sequence[str], user: str) -> DataFrame:
    """Every response keeps its row; a missing input is named as such in ``user``."""
    return responses.join(inputs, list(on), "left").withColumn(
        user, F.coalesce(F.col(user), F.lit(INPUT_NOT_FOUND)))


def align_by_custom_id(requests: DataFrame, responses: DataFrame, how: str = "left", file: str = "file") -> DataFrame:
    """Match by file, batch and request id, which is safe when answers come back in any order.

    Batch and request ids start again in every file, so they only name a request together with it.
    """
    return requests.join(responses, [file, "batch_id", "custom_id"], how)


def resolve_input_file(responses: DataFrame, inputs: DataFrame) -> DataFrame:
    """For ``(task, response_name)`` the input file: same stem, else the task's first file.

    Both sides are file lists, reduced to distinct names before any join.
    """
    files = inputs.select("task", "input_name").distinct()
    by_stem = files.groupBy("task", N.stem(F.col("input_name")).alias("input_stem")).agg(
        F.min("input_name").alias("same_stem"))
    first = files.groupBy("task").agg(F.min("input_name").alias("first_file"))
    named = responses.select("task", "response_name").distinct().withColumn(
        "input_stem", N.input_stem(F.col("response_name")))
    matched = joins.lookup_join(named, by_stem, ["task", "input_stem"], "left", ["response_name"])
    found = joins.lookup_join(matched, first, ["task"], "left", ["response_name"])
    return found.select("task", "response_name",
                        F.coalesce("same_stem", "first_file").alias("input_name"))


#: Bytes of a text above which its answers are cut out before they are parsed; a VARIANT holds 128 MB.
LARGE_TEXT = 64 << 20


def decode_batch_output(df: DataFrame, text: str, keep: Sequence[str], large_text: int = LARGE_TEXT) -> DataFrame:
    """Downloaded output to one VARIANT per answer.

    A text that is one JSON value, on one line or on several, gives its elements; otherwise every
    line is parsed by itself, and a line that does not parse becomes the content of an answer. Of a text above ``large_text`` bytes only single answers have to fit into a VARIANT.
    """
    def one(line: Column) -> Column:
        return F.coalesce(V.parse(line), F.to_variant_object(_wrapped(line)))

    small = F.coalesce(F.octet_length(text) <= large_text, F.lit(True))
    whole = V.parse(F.col(text))
    lines = F.filter(F.split(text, "\r?\n"), lambda line: line.rlike(r"\S"))
    items = F.when(whole.isNotNull(), F.coalesce(V.as_array(whole), F.array(whole))).otherwise(F.transform(lines, one))
    answers = df.where(small).select(*keep, F.posexplode(items).alias("line_no", "answer"))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    cut = df.where(~small).select(*keep, F.col(text).alias("__text")).mapInArrow(_cut_texts, f"{kinds}, line_no int, __line string")
    return answers.unionByName(cut.select(*keep, "line_no", one(F.col("__line")).alias("answer")))


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements of texts that are JSON documents, lines of all others, a few thousand at a time."""
    for batch in batches:
        for row in range(batch.num_rows):
            lines = _answers_of(batch.column(batch.num_columns - 1)[row].as_buffer().to_pybytes())
            for low in range(0, len(lines), 4096):
                some = lines[low:low + 4096]
                kept = [pa.concat_arrays([c.slice(row, 1)] * len(some)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(range(low, low + len(some)), pa.int32()), pa.array(some, pa.binary()).cast(pa.string())],
                                                 names=[*batch.schema.names[:-1], "line_no", "__line"])


def _answers_of(text: bytes) -> list[bytes]:
    cutter = Cutter("text")
    try:
        found = cutter.feed(text + b",")
        found += cutter.finish()
        if cutter.kind in ("[", "{") and (cutter.kind == "[" or json.loads(found[0]) is not None):
            return found
    except ValueError:
        pass
    return [line for line in text.replace(b"\r\n", b"\n").split(b"\n") if line.strip()]


def triples(df: DataFrame, system: Column, user: Column, assistant: Column, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, system.alias("system"), user.alias("user"), assistant.alias("assistant"))

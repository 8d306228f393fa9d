"""File, folder and result names."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptloom.functions.variants import let

# The compact folder stamp (the other one is day_month_year_time) and the fallback names.
COMPACT_STAMP = "yyyyMMdd_HHmmss"
DEFAULT_LANGUAGE = "en"
DEFAULT_TASK = "task"


def stem(file_name: Column) -> Column:
    """File name without folders and without its last extension."""
    return F.regexp_replace(F.regexp_replace(file_name, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def language_from_name(file_name: Column) -> Column:
    """Two ASCII letters before the first underscore, lower-cased; ``en`` otherwise."""
    head = F.split(stem(file_name), "_")[0]
    return F.when(head.rlike("^[A-Za-z]{2}$"), F.lower(head)).otherwise(DEFAULT_LANGUAGE)


def result_filename(file_name: Column, task: Column, size: Column) -> Column:
    return F.concat(
        F.concat_ws("_", language_from_name(file_name), task, stem(file_name), size.cast("string")),
        F.lit(".jsonl"))


def final_result_name(task: Column, count: Column) -> Column:
    return F.concat(task, F.lit("_"), count.cast("string"), F.lit(".jsonl"))


def raw_name(file_name: Column) -> Column:
    return F.concat(stem(file_name), F.lit("_raw_response.json"))


def formatted_name(file_name: Column) -> Column:
    return F.concat(input_stem(file_name), F.lit("_formatted_response.json"))


def parsed_name(file_name: Column) -> Column:
    return F.concat(F.lit("parsed_"), input_stem(file_name), F.lit(".jsonl"))


def combined_name(file_name: Column) -> Column:
    return F.concat(input_stem(file_name), F.lit("_combined_response.jsonl"))


def input_stem(response_name: Column) -> Column:
    """Name of the input a response file came from: both response suffixes taken off."""
    return F.regexp_replace(stem(response_name), r"(_batch_response|_raw_response)+$", "")


def task_folder_name(api: Column, task: Column, created_at: Column) -> Column:
    stamp = F.regexp_replace(created_at.cast("timestamp_ntz").cast("string"),
                             r"^(\d{4})-(\d{2})-(\d{2}) (\d{2}):(\d{2}):(\d{2}).*$", "$3_$2_$1_$4$5$6")
    return F.concat_ws("_", api, task, stamp)


def task_path(root: Column, user: Column, folder: Column) -> Column:
    return F.concat_ws("/", root, user, folder)


def _stamp_time(stamp: Column) -> Column:
    """Zone-free time of either stamp, null for anything that is no date."""
    day_first = F.regexp_replace(stamp, r"^(\d{2})_(\d{2})_(\d{4})_(\d{2})(\d{2})(\d{2})$", "$3-$2-$1 $4:$5:$6")
    iso = F.regexp_replace(day_first, r"^(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})$", "$1-$2-$3 $4:$5:$6")
    return iso.try_cast("timestamp_ntz")


def parse_task_path(path: Column) -> Column:
    """Struct ``user_id, api_name, task_name, created_at`` from ``.../<user>/<api>_<task>_<stamp>``."""
    folders = F.split(F.rtrim(path, F.lit("/")), "/")
    cut = F.regexp_replace(F.element_at(folders, -1),
                           r"^([^_]+)_(.+)_(\d{2}_\d{2}_\d{4}_\d{6}|\d{8}_\d{6})$", "$1/$2/$3")
    return let(F.split(cut, "/"), lambda parts: F.struct(
        F.coalesce(F.try_element_at(folders, F.lit(-2)), F.lit("unknown")).alias("user_id"),
        parts[0].alias("api_name"),
        F.coalesce(F.get(parts, F.lit(1)), F.lit("unknown")).alias("task_name"),
        _stamp_time(F.get(parts, F.lit(2))).alias("created_at")))


def resolve_task_name(config_name: Column, nested_name: Column, folder: Column) -> Column:
    """Configured name, else nested name, else first token of the folder, else ``task``."""
    def present(c: Column) -> Column:
        return F.nullif(c, F.lit(""))
    return F.coalesce(present(config_name), present(nested_name),
                      present(F.split(folder, "_")[0]), F.lit(DEFAULT_TASK))

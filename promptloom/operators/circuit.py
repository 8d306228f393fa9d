"""Circuit breaker over a table of calls: which calls would have been rejected.

The state after a call depends on all calls before it. Calls of a provider are cut into ranges; a first
pass works out what each range does to any state it may be entered with, a fold over these few
summaries gives the state each range starts with, and a second pass labels the calls.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.operators import ordered

MAX_FAILURES = 3
RESET_SECONDS = 60


def step(failures: int, opened: int | None, us: int, ok: bool, max_failures: int, reset_us: int):
    """One call: new failure count, new opening time, and what happened to the call."""
    if opened is not None and us - opened < reset_us:
        return failures, opened, "rejected"
    if ok:
        return 0, None, "success"
    failures = min(failures + 1, max_failures)
    return failures, (us if failures >= max_failures else None), "failure"


def label_sorted(frames: Iterator[pd.DataFrame], max_failures: int, reset_us: int) -> Iterator[pd.DataFrame]:
    """Outcome of each call of a partition sorted by provider, part and time.

    Only the current state is kept, so a group of any length passes through. At the first call of a group
    the state is the one the row brings along.
    """
    group, failures, opened = None, 0, None
    for frame in frames:
        outcomes, is_open = [], []
        starts_open = frame["opened"].astype("Int64").to_numpy(dtype=object, na_value=None)
        for provider, part, us, ok, start, start_open in zip(
                frame["provider"], frame["part"].tolist(), frame["us"].tolist(), frame["ok"].tolist(),
                frame["failures"].tolist(), starts_open):
            if group != (provider, part):
                group, failures, opened = (provider, part), start, start_open
            failures, opened, outcome = step(failures, opened, us, ok, max_failures, reset_us)
            outcomes.append(outcome)
            is_open.append(opened is not None)
        yield frame[["provider", "call_id"]].assign(outcome=outcomes, is_open=is_open)


def _summarize(us: np.ndarray, ok: np.ndarray, max_failures: int, reset_us: int) -> dict:
    """Final state of a range for every way it can be entered.

    States are numbered: ``0 .. max_failures-1`` closed with that many failures, ``max_failures + i``
    opened by call ``i``, ``-1`` not changed at all. Worked out from the last call backwards.
    """
    n = len(us)
    probe = np.maximum(np.searchsorted(us, us + reset_us, side="left"), np.arange(1, n + 1))
    closed = list(range(max_failures))
    closed_from = np.empty(n + 1, dtype=np.int64)
    closed_from[n] = 0
    tried = np.empty(n, dtype=np.int64)
    for i in range(n - 1, -1, -1):
        p = int(probe[i])
        opened = max_failures + i if p >= n else int(tried[p])
        tried[i] = closed_from[i + 1] if ok[i] else opened
        closed = [int(closed_from[i + 1])] * max_failures if ok[i] else [*closed[1:], opened]
        closed_from[i] = closed[0]
    reachable = int(np.searchsorted(us, us[0] + reset_us, side="left")) + 1
    heads = tried[:min(reachable, n)]
    ends = np.flatnonzero(np.append(heads[1:] != heads[:-1], True))

    def state(code: int) -> tuple[int, int | None]:
        return (code, None) if code < max_failures else (max_failures, int(us[code - max_failures]))

    exits = [state(c) for c in closed]
    probes = [state(int(heads[e])) for e in ends]
    return {
        "closed_failures": [f for f, _ in exits], "closed_opened": [o for _, o in exits],
        "probe_until": [int(us[e]) for e in ends],
        "probe_failures": [f for f, _ in probes], "probe_opened": [o for _, o in probes],
    }


_SUMMARY = ("closed_failures array<bigint>, closed_opened array<bigint>, probe_until array<bigint>, "
            "probe_failures array<bigint>, probe_opened array<bigint>")


def circuit_state(df: DataFrame, provider: str, call_id: str, micros: str, ok: str,
                  max_failures: int = MAX_FAILURES, reset_seconds: int = RESET_SECONDS) -> DataFrame:
    """``provider, call_id, outcome, is_open`` for every call."""
    reset_us = reset_seconds * 1_000_000
    slim = df.select(F.col(provider).cast("string").alias("provider"), F.col(call_id).cast("bigint").alias("call_id"),
                     F.col(micros).alias("us"), F.col(ok).alias("ok"))
    cold, hot = ordered.split_hot(slim, ["provider"], ["us", "call_id"])
    ready = cold.withColumns({"part": F.lit(0), "failures": F.lit(0).cast("bigint"), "opened": F.lit(None).cast("bigint")})
    if hot is not None:
        cut = hot.withColumnRenamed("__range", "part")
        ready = ready.unionByName(cut.join(_starts(cut, max_failures, reset_us), ["provider", "part"]))
    # A fixed number of tasks: the work per byte is high, so small partitions must not be merged.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = ready.repartition(tasks, "provider", "part").sortWithinPartitions("provider", "part", "us", "call_id")
    return placed.mapInPandas(lambda frames: label_sorted(frames, max_failures, reset_us),
                              "provider string, call_id bigint, outcome string, is_open boolean")


def _starts(cut: DataFrame, max_failures: int, reset_us: int) -> DataFrame:
    """State in which each ``(provider, part)`` is entered."""
    def summarize(pdf: pd.DataFrame) -> pd.DataFrame:
        calls = pdf.sort_values(["us", "call_id"], ignore_index=True)
        summary = _summarize(calls["us"].to_numpy(), calls["ok"].to_numpy(), max_failures, reset_us)
        return pd.DataFrame([{"provider": calls["provider"][0], "part": calls["part"][0], **summary}])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        failures, opened, starts = 0, None, []
        for row in pdf.sort_values("part").itertuples():
            starts.append((row.provider, row.part, failures, opened))
            if opened is None:
                left = row.closed_failures[failures], row.closed_opened[failures]
            else:
                place = int(np.searchsorted(np.asarray(row.probe_until), opened + reset_us, side="left"))
                if place >= len(row.probe_until):
                    continue
                left = row.probe_failures[place], row.probe_opened[place]
            failures = int(left[0])
            opened = None if left[1] is None or pd.isna(left[1]) else int(left[1])
        return pd.DataFrame(starts, columns=["provider", "part", "failures", "opened"]).astype({"opened": "Int64"})

    summaries = cut.groupBy("provider", "part").applyInPandas(summarize, f"provider string, part int, {_SUMMARY}")
    return summaries.groupBy("provider").applyInPandas(
        fold, "provider string, part int, failures bigint, opened bigint")

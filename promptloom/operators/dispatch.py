"""Sending request bodies to a provider supplied by the user."""
from __future__ import annotations

import random
import threading
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.operators.circuit import MAX_FAILURES, RESET_SECONDS
from promptloom.sources import workspace

MAX_TRIES = 5
BASE_DELAY = 1.0


class Retryable(Exception):
    """Raised by a provider for failures worth another try, such as rate limits."""


class Breaker:
    """Holds calls back for a while after several failures of the provider in a row; one per task, shared by its threads."""

    def __init__(self, max_failures: int, reset_seconds: float, clock: Callable[[], float] = time.monotonic):
        self._max, self._reset, self._clock = max_failures, reset_seconds, clock
        self._failures, self._opened, self._lock = 0, None, threading.Lock()

    def remaining(self) -> float:
        """Seconds until a call may be tried again, 0 while the breaker is closed."""
        with self._lock:
            return 0.0 if self._opened is None else max(0.0, self._opened + self._reset - self._clock())

    def refuses(self) -> bool:
        return self.remaining() > 0

    def record(self, ok: bool) -> None:
        with self._lock:
            self._failures = 0 if ok else self._failures + 1
            self._opened = self._clock() if self._failures >= self._max else None


def back_off(attempt: int, base: float, jitter: Callable[[float, float], float] = random.uniform) -> float:
    """Doubling delay after the given attempt (from 1) plus up to half of it at random."""
    delay = base * 2 ** (attempt - 1)
    return delay + jitter(0, delay / 2)


def send(call: Callable[[str], str], body: str, breaker: Breaker, tries: int, base: float,
         sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, int]:
    """Answer, error and number of attempts for one body.

    While the breaker is open the body waits and then serves as a probe; it is never given up unsent. A body that the provider turns
    down says nothing about the provider, so only bodies given up after failures worth retrying count against it.
    """
    for attempt in range(1, tries + 1):
        while (wait := breaker.remaining()) > 0:
            sleep(wait)
        try:
            answer = call(body)
        except Exception as failure:
            if isinstance(failure, Retryable):
                if attempt < tries:
                    sleep(back_off(attempt, base))
                    continue
                breaker.record(False)
            return None, str(failure) or type(failure).__name__, attempt
        breaker.record(True)
        return answer, None, attempt
    raise ValueError("tries must be at least 1")


class Bucket:
    """Tokens for calls: ``rate`` a second, at most ``burst`` saved up; ``take`` gives the seconds to wait for the next one."""

    def __init__(self, rate: float, burst: float = 1.0, clock: Callable[[], float] = time.monotonic):
        self._rate, self._burst, self._clock = rate, burst, clock
        self._saved, self._last, self._lock = burst, clock(), threading.Lock()

    def take(self) -> float:
        with self._lock:
            now = self._clock()
            self._saved = min(self._burst, self._saved + (now - self._last) * self._rate)
            self._last = now
            self._saved -= 1
            return max(0.0, -self._saved / self._rate)


class Route:
    """A provider of a task with its breaker and its share of the calls that the job may make a second."""

    def __init__(self, call: Callable[[str], str], max_failures: int, reset_seconds: float, rate: float | None):
        self.breaker = Breaker(max_failures, reset_seconds)
        self.bucket = Bucket(rate) if rate else None
        self._call = call

    def __call__(self, body: str) -> str:
        if self.bucket and (wait := self.bucket.take()) > 0:
            time.sleep(wait)
        return self._call(body)


LATE = "not sent before the deadline"
#: Bytes of requests that a task turns into Python objects at once.
SLICE_BYTES = 2 << 20


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to about ``SLICE_BYTES``: a batch is bounded by rows, and bodies may be long."""
    for batch in batches:
        step = max(1, batch.num_rows // (batch.nbytes // SLICE_BYTES + 1))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def dispatch(requests: DataFrame, make_provider: Callable[..., Callable[[str], str]], *,
             key: str = "request_key", body: str = "body", provider: str | None = None, rates: Mapping[str, float] | None = None,
             threads: int = 8, tasks: int | None = None, tries: int = MAX_TRIES, base_delay: float = BASE_DELAY,
             max_failures: int = MAX_FAILURES, reset_seconds: float = RESET_SECONDS, deadline_seconds: float | None = None) -> DataFrame:
    """``key, answer, error, attempts`` for every request.

    ``provider`` names a column that says which provider a row goes to; each name gets one provider a task, made by
    ``make_provider(name)``, with a breaker of its own, and ``rates`` bounds its calls a second over all ``tasks``. Without that column ``make_provider()`` makes the only one. A row whose
    provider cannot be made gets the reason as its error. Providers are called from a few threads; ``tasks * threads`` bounds the calls in flight.

    With ``deadline_seconds`` a task stops sending after that time and returns the rest with the error ``LATE`` and no attempts; without it a provider that stays down holds
    its rows until it is back. Write the result before using it twice: each evaluation sends again.
    """
    kind = requests.schema[key].dataType.simpleString()
    if rates and not tasks:
        raise ValueError("rates are shared by the tasks: give their number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        until = None if deadline_seconds is None else time.monotonic() + deadline_seconds
        routes: dict[str | None, Route | str] = {}

        def route(name: str | None) -> Route | str:
            if name not in routes:
                try:
                    made = make_provider(name) if provider else make_provider()
                except Exception as failure:  # the rows of this provider carry the reason
                    if not provider:
                        raise
                    routes[name] = str(failure) or type(failure).__name__
                else:
                    rate = (rates or {}).get(name)
                    routes[name] = Route(made, max_failures, reset_seconds, rate / tasks if rate else None)
            return routes[name]

        def one(name: str | None, text: str) -> tuple[str | None, str | None, int]:
            way = routes[name]
            if isinstance(way, str):
                return None, way, 0
            while until is not None and (wait := way.breaker.remaining()) > 0:
                if time.monotonic() + wait > until:
                    return None, LATE, 0
                time.sleep(wait)
            if until is not None and time.monotonic() > until:
                return None, LATE, 0
            return send(way, text, way.breaker, tries, base_delay)

        with ThreadPoolExecutor(max_workers=threads) as pool:
            for batch in _slices(batches):
                names = batch.column(2).to_pylist() if provider else [None] * batch.num_rows
                for name in dict.fromkeys(names):
                    route(name)
                results = list(pool.map(one, names, batch.column(1).to_pylist()))
                answers, errors, attempts = zip(*results) if results else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string()), pa.array(attempts, pa.int32())],
                                                 names=[key, "answer", "error", "attempts"])

    slim = requests.select(key, body, *([provider] if provider else []))
    slim = slim if tasks is None else slim.repartition(tasks)
    return slim.mapInArrow(run, f"`{key}` {kind}, answer string, error string, attempts int")


def answered(spark: SparkSession, path: str, key: str = "request_key") -> DataFrame | None:
    """Requests below ``path`` that were sent, once each; None before the first run."""
    if not workspace.exists(spark, path):
        return None
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path).where("attempts > 0")
    return rows.groupBy(key).agg(F.max_by(F.struct("answer", "error", "attempts"), F.col("answer").isNotNull()).alias("__best")).select(key, "__best.*")


def dispatch_once(requests: DataFrame, make_provider: Callable[..., Callable[[str], str]], path: str, *, key: str = "request_key", **options) -> DataFrame:
    """Send what ``path`` has no answer for yet and return the answers of all requests that were sent so far.

    The answers of a task are kept from the moment it ends, whatever becomes of the job: each run writes to a folder of its own with
    task-wise commits, and the folders are the record of what was sent. A run that was stopped is repeated by calling this again; it sends only requests without
    a committed answer. Requests turned down by their provider are not sent again; those that missed a deadline are. Other arguments are those of ``dispatch``.
    """
    spark = requests.sparkSession
    before = answered(spark, path, key)
    pending = requests if before is None else requests.join(before.select(key), key, "left_anti")
    sent = dispatch(pending, make_provider, key=key, **options)
    sent.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{path.rstrip('/')}/run-{uuid.uuid4().hex}")
    return requests.select(key).distinct().join(answered(spark, path, key), key, "left")

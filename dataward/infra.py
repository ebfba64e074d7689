"""Retries, circuit breakers, health checks and shutdown around Spark actions."""

from __future__ import annotations

import random
import threading
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import DatawardError

R = TypeVar("R")

# What a passing fault says of itself.
TRANSIENT = ("connection reset", "connection refused", "connection closed", "timed out", "timeout", "temporarily unavailable", "fetchfailed", "executor lost")


class CircuitOpenError(DatawardError):
    code = "CIRCUIT_OPEN"


def is_transient(error: BaseException) -> bool:
    return isinstance(error, (ConnectionError, TimeoutError)) or any(t in str(error).lower() for t in TRANSIENT)


def with_retry(work: Callable[[], R], attempts: int = 3, delay: float = 1.0, factor: float = 2.0, most: float = 30.0, jitter: float = 0.25, retry_on: Callable[[BaseException], bool] = is_transient, sleep: Callable[[float], None] = time.sleep) -> R:
    """Waits grow by the factor up to `most` seconds, each varied by the jitter."""
    for attempt in range(1, attempts + 1):
        try:
            return work()
        except Exception as e:
            if attempt == attempts or not retry_on(e):
                raise
            wait = min(most, delay * factor ** (attempt - 1))
            sleep(wait * (1 + random.uniform(-jitter, jitter)))
    raise AssertionError("attempts must be 1 or more")


class CircuitBreaker:
    """Opens after so many failures; after a pause lets one call through to see.

    Successes while closed leave the failures counted.
    """

    def __init__(self, threshold: int = 5, pause: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.threshold, self.pause, self.clock = threshold, pause, clock
        self.failures, self.opened_at, self.probing = 0, None, False
        self._lock = threading.Lock()

    @property
    def state(self) -> str:
        if self.opened_at is None:
            return "closed"
        return "half-open" if self.clock() - self.opened_at >= self.pause else "open"

    def call(self, work: Callable[[], R]) -> R:
        with self._lock:
            state = self.state
            if state == "open" or (state == "half-open" and self.probing):
                raise CircuitOpenError("the circuit is open")
            self.probing = probe = state == "half-open"
        try:
            result = work()
        except Exception:
            with self._lock:
                self.failures += 1
                if probe or self.failures >= self.threshold:
                    self.opened_at = self.clock()
                self.probing = False if probe else self.probing
            raise
        if probe:
            self.reset()
        return result

    def reset(self) -> None:
        with self._lock:
            self.failures, self.opened_at, self.probing = 0, None, False


def ping(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(1).alias("ping"))


def health(spark: SparkSession, healthy: float = 0.1, degraded: float = 0.5, clock: Callable[[], float] = time.monotonic) -> dict[str, Any]:
    """status by how long a smallest query takes."""
    began = clock()
    try:
        ok = ping(spark).first()["ping"] == 1
    except Exception as e:
        return {"status": "unhealthy", "error": str(e), "seconds": clock() - began}
    took = clock() - began
    return {"status": "unhealthy" if not ok or took >= degraded else "degraded" if took >= healthy else "healthy", "seconds": took}


def executors(spark: SparkSession) -> dict[str, int]:
    tracker = spark.sparkContext.statusTracker()
    return {"parallelism": spark.sparkContext.defaultParallelism, "active_jobs": len(tracker.getActiveJobsIds()), "active_stages": len(tracker.getActiveStageIds())}


class HealthMonitor:
    """Checks on an interval; calls back on changes and from so many failures in a row."""

    def __init__(self, check: Callable[[], dict[str, Any]], interval: float = 30.0, alert_after: int = 5, on_change: Callable[[str, str], None] | None = None, on_alert: Callable[[int], None] | None = None):
        self.check, self.interval, self.alert_after, self.on_change, self.on_alert = check, interval, alert_after, on_change, on_alert
        self.last, self.bad, self.history = None, 0, deque(maxlen=100)
        self._timer: threading.Timer | None = None

    def once(self) -> dict[str, Any]:
        found = self.check()
        self.history.append(found)
        if self.last is not None and found["status"] != self.last and self.on_change:
            self.on_change(self.last, found["status"])
        self.last = found["status"]
        self.bad = self.bad + 1 if found["status"] == "unhealthy" else 0
        if self.bad >= self.alert_after and self.on_alert:
            self.on_alert(self.bad)
        return found

    def start(self) -> None:
        self.once()
        self._timer = threading.Timer(self.interval, self.start)
        self._timer.daemon = True
        self._timer.start()

    def stop(self) -> None:
        if self._timer:
            self._timer.cancel()


@dataclass
class Shutdown:
    """Hooks that run once, last added first; what goes wrong is raised when all have run."""

    hooks: list[tuple[str, Callable[[], None]]] = field(default_factory=list)
    done: bool = False

    def add(self, name: str, hook: Callable[[], None]) -> None:
        self.hooks.append((name, hook))

    def run(self) -> None:
        if self.done:
            return
        self.done, wrong = True, []
        for name, hook in reversed(self.hooks):
            try:
                hook()
            except Exception as e:
                e.add_note(name)
                wrong.append(e)
        if wrong:
            raise ExceptionGroup("shutdown", wrong)


@dataclass
class QueryTimer:
    """Times actions and keeps the latest in a ring."""

    size: int = 1000
    clock: Callable[[], float] = time.perf_counter

    def __post_init__(self) -> None:
        self.records: deque[dict[str, Any]] = deque(maxlen=self.size)

    def run(self, name: str, action: Callable[[], R]) -> R:
        began, error = self.clock(), None
        try:
            return action()
        except Exception as e:
            error = str(e)
            raise
        finally:
            self.records.append({"id": len(self.records), "query_text": name, "duration_ms": (self.clock() - began) * 1000, "error": error})

    def slowest(self, limit: int = 10, over: float = 0.0) -> list[dict[str, Any]]:
        return sorted((r for r in self.records if r["duration_ms"] > over), key=lambda r: -r["duration_ms"])[:limit]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r.values()) for r in self.records], "id long, query_text string, duration_ms double, error string")

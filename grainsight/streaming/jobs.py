"""One background job at a time: progress, stop and a result that can be claimed once."""

from __future__ import annotations

import threading
import traceback
from collections.abc import Callable
from copy import deepcopy
from typing import Any

from pyspark.sql import SparkSession


class Job:
    """Runs `work(config, progress, should_stop)` in a thread under a Spark job tag.

    `stop` cancels the Spark jobs of the run; what an older run still reports is
    ignored.  InterruptedError, and errors after a stop, count as stopped.
    """

    def __init__(self, work: Callable[..., Any], spark: SparkSession | None = None):
        self.work, self.spark = work, spark
        self._lock = threading.Lock()
        self._stop, self._thread, self._run = threading.Event(), None, 0
        self._now: dict[str, Any] = {"running": False, "stopping": False, "pending": False, "current": 0, "total": 0, "name": ""}
        self._result: dict[str, Any] | None = None

    def start(self, config: dict[str, Any]) -> int:
        """The new run's number; RuntimeError while one is running."""
        with self._lock:
            if self._now["running"]:
                raise RuntimeError("a job is running already")
            self._run, self._stop, self._result = self._run + 1, threading.Event(), None
            self._now = {"running": True, "stopping": False, "pending": False, "current": 0, "total": 0, "name": "starting"}
            self._thread = threading.Thread(target=self._main, args=(deepcopy(config), self._run, self._stop), daemon=True)
            number = self._run
        self._thread.start()
        return number

    def _tag(self, number: int) -> str:
        return f"job-{id(self)}-{number}"

    def _main(self, config: dict[str, Any], number: int, stop: threading.Event) -> None:
        def progress(current: int, total: int, name: str) -> None:
            with self._lock:
                if self._run == number:
                    self._now |= {"current": int(current), "total": int(total), "name": str(name)}

        result: dict[str, Any] = {"stopped": False, "error": "", "trace": "", "value": None, "config": config}
        try:
            if self.spark is not None:
                self.spark.addTag(self._tag(number))
            result["value"] = self.work(config, progress, stop.is_set)
        except InterruptedError:
            result["stopped"] = True
        except Exception as e:  # noqa: BLE001 - a job reports every error
            result["stopped"] = stop.is_set()
            if not stop.is_set():
                plain = isinstance(e, (ValueError, OSError, RuntimeError))
                result |= {"error": str(e), "trace": "" if plain else traceback.format_exc()}
        with self._lock:
            if self._run == number:
                self._now |= {"running": False, "stopping": False, "pending": True}
                self._result = result

    def stop(self) -> None:
        with self._lock:
            self._stop.set()
            running, number = self._now["running"], self._run
            self._now["stopping"] = running
        if running and self.spark is not None:
            self.spark.interruptTag(self._tag(number)) if hasattr(self.spark, "interruptTag") else None

    def status(self) -> dict[str, Any]:
        with self._lock:
            return dict(self._now)

    def claim(self) -> dict[str, Any] | None:
        """The finished run's result, the first time it is asked for."""
        with self._lock:
            if self._now["running"] or not self._now["pending"]:
                return None
            self._now["pending"] = False
            result, self._result = self._result, None
            return result

    def wait(self, seconds: float | None = None) -> None:
        if self._thread is not None:
            self._thread.join(seconds)


class FocusJob(Job):
    """A focus search as a job: keeps the steps so far and lets one still be claimed after a success."""

    def __init__(self, search: Callable[..., Any], spark: SparkSession | None = None):
        super().__init__(self._searched, spark)
        self.search, self.steps, self._still = search, [], False

    def _searched(self, config: dict[str, Any], progress, should_stop) -> Any:
        self.steps, self._still = [], False

        def note(step: dict[str, Any]) -> None:
            self.steps.append(step)
            progress(len(self.steps), 0, step.get("phase", ""))

        found = self.search(config, note, should_stop)
        self._still = True
        return found

    def claim_still(self) -> bool:
        """True once after a finished search."""
        with self._lock:
            first, self._still = self._still and not self._now["running"], False
            return first

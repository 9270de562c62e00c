"""Time limits, progress lines and stall warnings around Spark jobs."""

from __future__ import annotations

import sys
import threading
import time
import uuid
from collections.abc import Callable
from typing import TextIO

from pyspark import InheritableThread
from pyspark.sql import SparkSession


def within(spark: SparkSession, seconds: float | None, action: Callable[[], object], drain: float = 0.2) -> tuple[object, bool]:
    """The action's result and whether it was cut off: after `seconds` its Spark jobs are cancelled. Its own errors are raised."""
    seconds = seconds if seconds is not None else threading.TIMEOUT_MAX
    tag, box = f"within-{uuid.uuid4().hex}", {}

    def run() -> None:
        spark.addTag(tag)
        try:
            box["value"] = action()
        except BaseException as e:  # noqa: BLE001
            box["error"] = e
        finally:
            spark.removeTag(tag)

    worker = InheritableThread(target=run, daemon=True)
    worker.start()
    try:
        worker.join(max(0.0, seconds))
    except KeyboardInterrupt:  # nothing goes on behind the caller's back
        spark.interruptTag(tag)
        raise
    if worker.is_alive():
        spark.interruptTag(tag)
        worker.join(drain)
        if "value" not in box:
            return None, True
    if "error" in box:
        raise box["error"]
    return box.get("value"), False


class Progress:
    """Status lines, and in verbose mode each contact as it is first seen; silent but for status if disabled."""

    def __init__(self, enabled: bool = True, verbose: bool = False, out: TextIO | None = None, stall: float = 20.0):
        self.enabled, self.verbose, self.out, self.stall = enabled, verbose, out or sys.stderr, stall
        self.seen: set[tuple[str, str]] = set()
        self.moved = time.monotonic()

    def status(self, line: str) -> None:
        print(line, file=self.out, flush=True)

    def step(self, name: str, done: int, of: int | None = None) -> None:
        self.moved = time.monotonic()
        if self.enabled:
            self.status(f"[{name}] {done:,}" + (f" of {of:,}" if of is not None else ""))

    def contact(self, kind: str, value: str, day: str = "", url: str = "") -> bool:
        """Whether the contact is new."""
        if (kind, value) in self.seen:
            return False
        self.seen.add((kind, value))
        if self.enabled:
            self.status(f"  + {kind:5}  {value}" + (f"  {day}  {url}" if self.verbose else ""))
        return True

    def watch(self, every: float = 0.5) -> Callable[[], None]:
        """Warn once whenever nothing has moved for `stall` seconds; the result ends the watch."""
        ended = threading.Event()

        def run() -> None:
            warned = 0.0
            while not ended.wait(every):
                if time.monotonic() - self.moved > self.stall and warned != self.moved:
                    warned = self.moved
                    self.status(f"[!] no progress for {self.stall:.0f}s")

        threading.Thread(target=run, daemon=True).start()
        return ended.set

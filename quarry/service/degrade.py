"""Searches that answer in time: reranked if that is done soon enough, else the hybrid order."""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

#: Seconds that a reranked search may take, and the environment's name for another number.
BUDGET, BUDGET_NAME = 25, "QUARRY_SEARCH_TIMEOUT"
BUSY, LATE = "rerank_busy", "rerank_timeout"


def budget() -> float:
    text = os.environ.get(BUDGET_NAME, "")
    return float(text) if text.isdigit() and int(text) > 0 else float(BUDGET)


@dataclass
class Reranker:
    """One reranked search at a time. A search that comes meanwhile, or takes longer than
    ``seconds``, gets the plain answer and the reason; the late one is cancelled by its tag."""

    spark: SparkSession | None = None
    seconds: float = field(default_factory=budget)
    busy: threading.Lock = field(default_factory=threading.Lock)

    def run(self, full: Callable[[], object], plain: Callable[[], object]) -> tuple[object, str]:
        """The result, and why it is the plain one (empty if it isn't)."""
        if not self.busy.acquire(blocking=False):
            return plain(), BUSY
        tag, done, out = f"rerank-{uuid.uuid4().hex}", threading.Event(), {}

        def work() -> None:
            try:
                if self.spark is not None:
                    self.spark.addTag(tag)
                out["result"] = full()
            except Exception as error:  # noqa: BLE001  raised again where it is waited for
                out["error"] = error
            finally:
                self.busy.release()
                done.set()

        threading.Thread(target=work, daemon=True).start()
        if not done.wait(self.seconds):
            if self.spark is not None:
                self.spark.interruptTag(tag)
            return plain(), LATE
        if "error" in out:
            raise out["error"]
        return out["result"], ""

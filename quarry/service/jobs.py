"""Background work of a service: one job at a time, with the last lines of its log."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable
from datetime import UTC, datetime

#: Lines that a job's log keeps.
LINES = 500


class Busy(RuntimeError):
    """Another job is running."""


class Jobs:
    def __init__(self, lines: int = LINES):
        self.gate, self.log = threading.Lock(), deque(maxlen=lines)
        self.state: dict = {"running": False, "name": "", "error": "", "result": None}
        self.stop = threading.Event()

    def say(self, line: str) -> None:
        self.log.append(f"{datetime.now(UTC).isoformat(timespec='seconds')} {line}")

    def start(self, name: str, work: Callable[[], object], then: Callable[[], None] = lambda: None) -> threading.Thread:
        """Runs ``work`` in the background and ``then`` after it went well; an error if a job is running."""
        if not self.gate.acquire(blocking=False):
            raise Busy(f"{self.state['name']} is running")
        self.stop.clear()
        self.state = {"running": True, "name": name, "error": "", "result": None}

        def run() -> None:
            try:
                self.say(f"{name}: begins")
                self.state["result"] = work()
                then()
                self.say(f"{name}: done")
            except Exception as error:  # noqa: BLE001  shown in the state
                self.state["error"] = str(error).splitlines()[0] if str(error) else type(error).__name__
                self.say(f"{name}: {self.state['error']}")
            finally:
                self.state["running"] = False
                self.gate.release()

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        return thread

    def cancel(self) -> None:
        """Asks the running job to end at its next batch."""
        self.stop.set()

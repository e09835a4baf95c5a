"""What happens in a run: one list of events, from which the report takes its tallies and timings."""

from __future__ import annotations

import time
from collections import Counter
from itertools import pairwise

PHASES = ("scan", "check", "source", "publish", "report")
#: What an event of a kind carries besides its own facts.
_CARRIES = {
    "issue": ("issue_counts",),
    **dict.fromkeys(("scan_complete", "source_complete", "partition_complete"), ("issue_counts", "counts", "phase_elapsed_seconds")),
}


class RunLog:
    """Events in order, for a listener as they come and for the report; issues are among them.

    The report's issue_counts and timings are brought up to date with every event that changes them.
    """

    def __init__(self, report: dict, listener=None):
        self.report, self.listener = report, listener
        self.began = time.monotonic()
        self.events: list[dict] = []
        #: (phase, seconds since the beginning), and (None, seconds) where a phase ends without another.
        self.marks: list[tuple[str | None, float]] = []

    def _seconds(self) -> float:
        return time.monotonic() - self.began

    def emit(self, kind: str, **facts) -> None:
        now = self._seconds()
        known = {
            "issue_counts": lambda: dict(self.report["issue_counts"]),
            "counts": lambda: dict(self.report["counts"]),
            "phase_elapsed_seconds": lambda: now - self.marks[-1][1] if self.marks else now,
        }
        self.events.append({"event": kind, **facts, "elapsed_seconds": now, **{k: known[k]() for k in _CARRIES.get(kind, ())}})
        if self.listener:
            self.listener(self.events[-1])

    def phase(self, name: str) -> None:
        self._mark(name)
        self.emit("phase", phase=name, index=PHASES.index(name) + 1, total=len(PHASES))

    def close(self) -> None:
        """End the phase; the report's durations stand from here on."""
        if self.marks and self.marks[-1][0]:
            self._mark(None)
            self.report["elapsed_seconds"] = self.marks[-1][1]

    def _mark(self, name: str | None) -> None:
        self.marks.append((name, self._seconds()))
        spent = Counter()
        for (phase, start), (_, end) in pairwise(self.marks):
            if phase:
                spent[phase] += end - start
        self.report["timings"] = dict(spent)

    def issue(self, reason, path=None, category: str = "error", **details) -> None:
        """An issue by its reason, which may be an exception with details."""
        where = {} if path is None else {"path": str(path)}
        self.issues([{"category": category, "reason": str(reason), **getattr(reason, "details", {}), **where, **details}])

    def issues(self, items) -> None:
        """Finished issues; errors and warnings are events of their own."""
        for item in items:
            self.report["issues"].append(item)
            self.report["issue_counts"][item["category"]] = self.report["issue_counts"].get(item["category"], 0) + 1
            if item["category"] in ("error", "warning"):
                self.emit("issue", issue=dict(item))

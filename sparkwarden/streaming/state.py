"""Keyed state of the streaming rules: plain functions over the rows of one key in one micro-batch.

Only rows that can matter to a rule reach these functions, and a batch holds what has arrived since the last one. A window
is kept as (time, count) pairs, so a burst within one second is one pair.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import pandas as pd

PAIRS = "array<bigint>"


class Window:
    """Times in order with how often each is there, and their running total. A row costs what it drops."""

    def __init__(self, times=(), counts=()):
        self.times, self.counts = deque(times), deque(counts)
        self.n = sum(self.counts)

    def add(self, t: int, width: int, is_open: bool) -> int:
        """Adds t, drops what is out of the window ending at t, and returns the number left."""
        self.n += 1
        if self.times and self.times[-1] >= t:
            at = bisect_left(self.times, t)  # a late row goes to its place
            if self.times[at] == t:
                self.counts[at] += 1
            else:
                self.times.insert(at, t)
                self.counts.insert(at, 1)
        else:
            self.times.append(t)
            self.counts.append(1)
        low = t - width
        while self.times[0] < low or is_open and self.times[0] == low:
            self.times.popleft()
            self.n -= self.counts.popleft()
        return self.n

    def total(self) -> int:
        return self.n

    def clear(self) -> None:
        self.times.clear()
        self.counts.clear()
        self.n = 0


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    rows = pd.concat([f for f in frames if len(f)])
    return rows.sort_values(["t", "seq"], kind="stable")


def auth_and_404(config, columns: list[str]):
    """Rules over failed logins, logins and 404s of one source."""
    fail_w, miss_w = config.auth_window_s * 1_000_000, config.not_found_window_s * 1_000_000

    def run(key, frames, state):
        old = state.get if state.exists else ([], [], [], [])
        fails, misses = Window(old[0], old[1]), Window(old[2], old[3])
        rows = _in_order(frames)
        out = []
        for i, (t, failed, login, missed) in enumerate(rows[["t", "is_failure", "is_login", "is_404"]].itertuples(index=False)):
            if failed:
                n = fails.add(t, fail_w, True)
                if n >= config.auth_failures_medium:
                    out.append((i, "R001" if n >= config.auth_failures_high else "R014", n))
            if login and fails.total() >= config.auth_failures_medium:
                out.append((i, "R002", fails.total() + 1))
                fails.clear()
            if missed:
                n = misses.add(t, miss_w, True)
                if n >= config.not_found_min:
                    out.append((i, "R015", n))
        state.update(tuple(list(x) for x in (fails.times, fails.counts, misses.times, misses.counts)))
        hits = rows[columns].iloc[[o[0] for o in out]].copy()
        hits["rule_id"] = [o[1] for o in out]
        hits["event_count"] = [o[2] for o in out]
        yield hits
    return run


AUTH_STATE = f"fail_t {PAIRS}, fail_n {PAIRS}, miss_t {PAIRS}, miss_n {PAIRS}"


UPDATE = "incident_key string, seq bigint, t bigint, n bigint"
UPDATE_STATE = f"times {PAIRS}, counts {PAIRS}, n bigint"


def incident_windows(config):
    """Updates of one subject: a source's failures and compromises, a service's crashes, or a source's paths.

    The key is (kind, subject); state is a window for the first two and a number for paths.
    """
    failure_w, crash_w = config.brute_force_window_s * 1_000_000, config.service_window_s * 1_000_000

    def run(key, frames, state):
        kind, subject = key
        old = state.get if state.exists else ([], [], 0)
        seen, paths = Window(old[0], old[1]), old[2]
        out = []
        for t, seq, rule, is_new in _in_order(frames)[["t", "seq", "rule_id", "is_new"]].itertuples(index=False):
            if kind == "path":
                paths += int(is_new)
                if paths >= config.web_paths_min:
                    out.append((f"web_recon:{subject}", seq, t, paths))
            elif kind == "crash":
                n = seen.add(t, crash_w, False)
                if n >= config.service_min:
                    out.append((f"service_fail:{subject}", seq, t, n))
            elif rule == "R002":
                out.append((f"account_compromise:{subject}", seq, t, seen.total()))
            else:
                n = seen.add(t, failure_w, False)
                if n >= config.brute_force_min:
                    out.append((f"brute_force:{subject}", seq, t, n))
        state.update((list(seen.times), list(seen.counts), paths))
        yield pd.DataFrame(out, columns=["incident_key", "seq", "t", "n"])
    return run


def first_of_path(key, frames, state):
    """Marks the first row of a (source, path). State is one flag per pair, so it spreads over all tasks."""
    rows = _in_order(frames)[["ip", "t", "seq"]].copy()
    rows["is_new"] = 0
    if not state.exists:
        rows.iloc[0, 3] = 1
        state.update((True,))
    yield rows

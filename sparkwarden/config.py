"""Thresholds and switches. Every operator takes a Config, so none of these is hidden in code."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # BSD lines carry no year, so it has to be given.
    year: int = 2024
    # Time of lines whose own time cannot be read; None means the file's modification time.
    fallback_ts: str | None = None

    # Detection windows: half open, (t - window, t].
    auth_window_s: int = 60
    auth_failures_medium: int = 3
    auth_failures_high: int = 5
    not_found_window_s: int = 30
    not_found_min: int = 10

    # Correlation windows: closed, [t - window, t].
    brute_force_window_s: int = 60
    brute_force_min: int = 5
    service_window_s: int = 60
    service_min: int = 3
    # Distinct paths over the whole history of a source; the window only appears in the texts.
    web_paths_min: int = 20
    web_window_s: int = 30

    # The port scan rule is declared but not evaluated by default.
    port_scan_rule: bool = False
    port_scan_window_s: int = 30
    port_scan_min: int = 20

    merge_window_s: int = 300
    raw_refs: int = 50

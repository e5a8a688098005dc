"""Column layouts of the tables."""

from __future__ import annotations

LINES = "seq bigint, value string, source_file string, modified timestamp"

ENTRY_COLUMNS = [
    "seq", "event_id", "timestamp", "hostname", "source_ip", "destination_ip", "username", "service", "process",
    "event_type", "message", "raw_log", "severity", "log_format", "source_file",
]

# What an alert or an incident update keeps of its entry; the texts stay in the entries table.
SLIM_COLUMNS = [
    "seq", "t", "timestamp", "event_id", "source_ip", "username", "hostname", "service", "process",
    "event_type", "severity", "source_file", "web_flag", "path",
]

ALERT_ACTIONS = "alert_id string, action string, ts timestamp, note string"
INCIDENT_ACTIONS = "incident_id string, action string, ts timestamp, note string"

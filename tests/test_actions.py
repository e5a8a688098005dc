"""Incident actions against a plain walk through the statuses."""

import datetime as dt
import random

from sparkwarden.operators.actions import apply_alert_actions, apply_incident_actions

STEP = {"investigate": ("ACTIVE", "INVESTIGATING"), "resolve": ("INVESTIGATING", "RESOLVED"), "close": ("RESOLVED", "CLOSED")}
BASE = dt.datetime(2024, 1, 1)


def test_incident_actions(spark):
    rnd = random.Random(2)
    names = ["investigate", "resolve", "close", "reopen", "Investigate", "dismiss"]
    start = {f"i{k}": rnd.choice(["ACTIVE", "INVESTIGATING", "RESOLVED", "CLOSED"]) for k in range(30)}
    rows = [(k, rnd.choice(names), BASE + dt.timedelta(seconds=i), "") for k in start for i in range(rnd.randint(0, 12))]
    rows.append(("gone", "close", BASE, ""))
    status, refused = dict(start), []
    for k, action, ts, _ in rows:
        act = action.lower()
        if act == "dismiss":
            refused.append((k, act, ts, "unknown action"))
        elif k not in status:
            refused.append((k, act, ts, "unknown incident"))
        elif act == "reopen":
            status[k] = "ACTIVE"
        elif STEP[act][0] == status[k]:
            status[k] = STEP[act][1]
        else:
            refused.append((k, act, ts, f"not allowed in status {status[k]}"))
    d, r = apply_incident_actions(spark.createDataFrame(list(start.items()), "incident_key string, status string"),
                                  spark.createDataFrame(rows, "incident_id string, action string, ts timestamp, note string"))
    assert {x.incident_key: x.status for x in d.collect()} == status
    assert sorted((x.incident_id, x.action, x.ts, x.reason) for x in r.collect()) == sorted(refused)


def test_alert_actions(spark):
    alerts = spark.createDataFrame([("a", "ACTIVE"), ("b", "ACTIVE"), ("c", "ACTIVE")], "alert_id string, status string")
    rows = [("a", "acknowledge", BASE, ""), ("a", "resolve", BASE + dt.timedelta(1), ""), ("b", "hide", BASE, ""), ("x", "resolve", BASE, "")]
    d, r = apply_alert_actions(alerts, spark.createDataFrame(rows, "alert_id string, action string, ts timestamp, note string"))
    assert sorted(map(tuple, d.collect())) == [("a", "RESOLVED"), ("b", "ACTIVE"), ("c", "ACTIVE")]
    assert sorted((x.alert_id, x.reason) for x in r.collect()) == [("b", "unknown action"), ("x", "unknown alert")]

"""Alerting entries to incident updates, and updates to incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden import dims
from sparkwarden.config import Config
from sparkwarden.operators.detect import UNKNOWN, has_rule
from sparkwarden.operators.ordered import SECOND, Running, Sliding, first_rows, with_totals
from sparkwarden.schema import SLIM_COLUMNS

FAILURES = ("R001", "R014")
SCENARIO = {s[0]: s for s in dims.SCENARIOS}


def _ip() -> Column:
    return F.coalesce("source_ip", F.lit(UNKNOWN))


def _updates(rows: DataFrame, scenario: str, subject: Column, n: Column) -> DataFrame:
    _, ord_, kind, severity = SCENARIO[scenario]
    entry = [F.col("severity").alias("entry_severity") if c == "severity" else c
             for c in SLIM_COLUMNS if c not in ("web_flag", "path")]
    return rows.select(
        F.concat(F.lit(f"{scenario}:"), subject).alias("incident_key"), F.lit(kind).alias("incident_type"),
        F.lit(severity).alias("severity"), F.lit(ord_).alias("ord"), subject.alias("subject"), n.cast("bigint").alias("n"),
        *entry, "hits")


def failure_scan(detected: DataFrame, config: Config) -> DataFrame:
    """Entries with a failure alert and their number in the closed window."""
    d = detected.where(has_rule(*FAILURES)).withColumn("ip", _ip())
    return with_totals(d, ["ip"], {"n": Sliding(F.lit(1), config.brute_force_window_s * SECOND, open=False)})


def brute_force(detected: DataFrame, config: Config) -> DataFrame:
    d = failure_scan(detected, config).where(F.col("n") >= config.brute_force_min)
    return _updates(d, "brute_force", F.col("ip"), F.col("n"))


def account_compromise(detected: DataFrame, config: Config) -> DataFrame:
    """The count a login reports is that of the source's last failure: found by its number, not by a window."""
    def fail_no(*rules: str) -> Column:
        return F.get(F.filter("hits", lambda h: h["rule_id"].isin(*rules)), F.lit(0))["fail_no"]
    logins = detected.where(has_rule("R002")).withColumn("ip", _ip()).withColumn("fail_no", fail_no("R002"))
    failures = failure_scan(detected, config).select("ip", fail_no(*FAILURES).alias("fail_no"), "n")
    d = logins.join(failures, ["ip", "fail_no"], "left")
    return _updates(d, "account_compromise", F.col("ip"), F.coalesce("n", F.lit(0)))


def web_recon(scanned: DataFrame, detected: DataFrame, config: Config) -> DataFrame:
    """Sources with many distinct paths so far. The first use of a path is marked by a partial minimum per path."""
    web = scanned.where("web_flag").select(*SLIM_COLUMNS)
    other = detected.where(~F.col("web_flag") & has_rule("R015")).select(*SLIM_COLUMNS)
    rows = web.unionByName(other).withColumn("ip", _ip())
    firsts = (rows.groupBy("ip", "path").agg(F.min(F.struct("t", "seq")).alias("p"))
              .select("ip", "p.t", "p.seq", F.lit(1).alias("new")))
    steps = rows.withColumn("new", F.lit(0)).withColumn("real", F.lit(True)).unionByName(firsts, allowMissingColumns=True)
    counted = with_totals(steps, ["ip"], {"n": Running(F.col("new"))}).where("real")
    counted = counted.where(F.col("n") >= config.web_paths_min).drop("new", "real")
    d = counted.join(detected.select("seq", "hits"), "seq", "left")
    none = F.array().cast(detected.schema["hits"].dataType)
    return _updates(d.withColumn("hits", F.coalesce("hits", none)), "web_recon", F.col("ip"), F.col("n"))


def priv_esc(detected: DataFrame) -> DataFrame:
    d = detected.where(has_rule("R005"))
    user = F.when(F.col("username") != "", F.col("username"))
    return _updates(d, "priv_esc", F.coalesce(user, F.lit(UNKNOWN)), F.lit(1))


def service_failure(detected: DataFrame, config: Config) -> DataFrame:
    service = F.when(F.col("service") != "", F.col("service"))
    d = detected.where(has_rule("R013")).withColumn("svc", F.coalesce(service, F.lit(UNKNOWN)))
    d = with_totals(d, ["svc"], {"n": Sliding(F.lit(1), config.service_window_s * SECOND, open=False)})
    return _updates(d.where(F.col("n") >= config.service_min), "service_fail", F.col("svc"), F.col("n"))


def incident_updates(scanned: DataFrame, detected: DataFrame, config: Config) -> DataFrame:
    return (brute_force(detected, config).unionByName(account_compromise(detected, config))
            .unionByName(web_recon(scanned, detected, config)).unionByName(priv_esc(detected))
            .unionByName(service_failure(detected, config)))


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _per_type(texts: dict[str, Column], otherwise: Column) -> Column:
    out = None
    for kind, text in texts.items():
        cond = F.col("incident_type") == kind
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return out.otherwise(otherwise)


def update_text(config: Config) -> Column:
    """Timeline text of an update, from its subject and count."""
    s, n = F.col("subject"), F.col("n")
    return _per_type({
        "Brute Force Attack": _text("Failed login attempt #", n, " from ", s),
        "Account Compromise": _text("Successful login from ", s, " after ", n, " failed attempts"),
        "Web Reconnaissance": _text("Web enumeration: ", n, " unique paths probed by ", s),
        "Privilege Escalation Sequence": _text("Privilege escalation by user ", s),
        "Repeated Service Failure": _text("Service '", s, "' crashed ", n, f" times in {config.service_window_s}s"),
    }, F.lit(""))


def explanation_text(config: Config) -> Column:
    """Why an incident was raised, from its subject and the count of its last update."""
    s, n = F.col("subject"), F.col("n")
    return _per_type({
        "Brute Force Attack": _text(
            "Detected ", n, " failed authentication attempts from ", s,
            f" within a {config.brute_force_window_s}-second window, exceeding the threshold of {config.brute_force_min}."),
        "Account Compromise": _text(
            "Source IP ", s, " made ", n, " failed login attempts before successfully authenticating. This pattern strongly "
            "indicates a brute-force credential compromise."),
        "Web Reconnaissance": _text(
            "Source IP ", s, " probed ", n, f" unique paths within {config.web_window_s} seconds, indicating systematic web "
            "reconnaissance."),
        "Privilege Escalation Sequence": _text(
            "User '", s, "' performed privilege escalation. Investigating whether this follows a recent login or is part of "
            "a lateral movement."),
        "Repeated Service Failure": _text(
            "Service '", s, "' failed ", n, f" times within {config.service_window_s} seconds. This may indicate a "
            "denial-of-service condition or a persistent bug."),
    }, F.lit(""))


def timeline(updates: DataFrame, config: Config) -> DataFrame:
    """Timeline rows of all incidents. A compromise adds a second row to each of its updates."""
    c = F.col
    main = F.struct(F.lit(0).alias("sub"), c("event_type").alias("event_type"), update_text(config).alias("description"),
                    c("entry_severity").alias("severity"))
    extra = F.struct(F.lit(1).alias("sub"), F.lit("Critical").alias("event_type"),
                     F.lit("Critical Incident Created — Possible Account Compromise").alias("description"),
                     F.lit("CRITICAL").alias("severity"))
    rows = F.when(c("incident_type") == "Account Compromise", F.array(main, extra)).otherwise(F.array(main))
    return (updates.select("incident_key", "incident_type", "t", "seq", "timestamp", F.explode(rows).alias("x"))
            .select("incident_key", "incident_type", "t", "seq", "timestamp", "x.*"))


def incident_ips(updates: DataFrame) -> DataFrame:
    """Distinct sources of each incident with their first position. A table, as a list could outgrow a row."""
    return (updates.where(F.col("source_ip") != "").groupBy("incident_key", "source_ip")
            .agg(F.min(F.struct("t", "seq")).alias("first_pos")))


def incident_rules(updates: DataFrame) -> DataFrame:
    """Distinct rules of each incident with their first position."""
    return (updates.select("incident_key", "t", "seq", F.explode("hits").alias("h"))
            .groupBy("incident_key", F.col("h.rule_id").alias("rule_id"))
            .agg(F.min(F.struct("t", "seq", F.col("h.ord").alias("rule_ord"))).alias("first_pos")))


def rule_list(rules: DataFrame, keys: list[str]) -> DataFrame:
    """triggered_rules and mitre_techniques in order of first use. At most one element per rule of the rules table."""
    mitre = F.create_map(*[F.lit(x) for k, v in dims.RULE_MITRE.items() if v for x in (k, v)])
    listed = (rules.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("first_pos", "rule_id"))).alias("r"))
              .select(*keys, F.transform("r", lambda x: x["rule_id"]).alias("triggered_rules")))
    techniques = F.array_distinct(F.array_compact(F.transform("triggered_rules", lambda r: mitre[r])))
    return listed.withColumn("mitre_techniques", techniques)


def build_incidents(updates: DataFrame, config: Config) -> DataFrame:
    """One row per incident. All aggregates combine before the shuffle; only lists of bounded length are kept.

    first_sources has the first five sources, for the texts that name some; incident_ips() has all of them, a row each.
    """
    c = F.col
    pos = F.struct("t", "seq")
    has_user, has_ip = c("username") != "", c("source_ip") != ""
    base = updates.groupBy("incident_key", "incident_type", "severity", "ord", "subject").agg(
        F.count("*").alias("total_events"), F.sum(F.size("hits")).alias("alert_count"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"), F.max_by("n", pos).alias("n"),
        F.max_by("username", F.when(has_user, pos)).alias("target_user"),
        F.min_by("source_ip", F.when(has_ip, pos)).alias("first_ip"), F.min(F.when(has_ip, pos)).alias("first_ip_pos"),
        F.min_by("username", pos).alias("first_row_user"))
    ips = incident_ips(updates)
    some = (first_rows(ips, ["incident_key"], ["first_pos"], 5).groupBy("incident_key")
            .agg(F.sort_array(F.collect_list(F.struct("rn", "source_ip"))).alias("s"))
            .select("incident_key", F.transform("s", lambda x: x["source_ip"]).alias("first_sources")))
    counts = ips.groupBy("incident_key").agg(F.count("*").alias("ip_count"))
    rules = rule_list(incident_rules(updates), ["incident_key"])
    nothing = F.array().cast("array<string>")
    d = (base.join(some, "incident_key", "left").join(counts, "incident_key", "left").join(rules, "incident_key", "left"))
    for name in ("first_sources", "triggered_rules", "mitre_techniques"):
        d = d.withColumn(name, F.coalesce(name, nothing))
    return (d.withColumn("ip_count", F.coalesce("ip_count", F.lit(0)))
            .withColumn("correlation_explanation", explanation_text(config)).withColumn("status", F.lit("ACTIVE")))


def admissions(updates: DataFrame) -> DataFrame:
    """First update at which an incident passes the false-positive filter: the tests can only fail on the first two.

    An incident that never passes has no row.
    """
    from sparkwarden.functions.scoring import event_count_points, rule_certainty_points, signal_points
    c = F.col
    first = first_rows(updates, ["incident_key"], ["t", "seq"], 3)
    mitre = F.create_map(*[F.lit(x) for k, v in dims.RULE_MITRE.items() if v for x in (k, v)])
    rules = F.transform("hits", lambda h: h["rule_id"])
    signals = (F.size("hits") + F.size(F.array_distinct(F.array_compact(F.transform(rules, lambda r: mitre[r]))))
               + F.when(c("source_ip") != "", 1).otherwise(0))
    # With one event the density score is 20.
    confidence = F.bround(event_count_points(F.lit(1)) * 0.30 + F.lit(20.0) * 0.25 + rule_certainty_points(c("severity")) * 0.25
                          + signal_points(signals) * 0.20, 1)
    service = c("incident_type") == "Repeated Service Failure"
    keep = (F.when(service, c("rn") >= 3)
            .when(c("rn") == 1, (confidence >= 40) & (F.size("hits") > 1)).otherwise(True))
    return first.where(keep).groupBy("incident_key").agg(F.min(F.struct("t", "seq", "ord")).alias("admitted_pos"))

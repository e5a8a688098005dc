"""Texts of an incident as columns over its row. The sentences are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkwarden import dims
from sparkwarden.functions.rounding import fixed
from sparkwarden.functions.scoring import duration_s

c = F.col


def text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def by_type(texts: dict[str, Column], otherwise: Column) -> Column:
    out = None
    for kind, value in texts.items():
        cond = c("incident_type") == kind
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(otherwise)


def _first(array: str, n: int) -> Column:
    return F.array_join(F.slice(array, 1, n), ", ")


def _ips(n: int, none: str) -> Column:
    return F.when(F.size("first_sources") > 0, _first("first_sources", n)).otherwise(none)


def _user(none: str) -> Column:
    return F.coalesce("target_user", F.lit(none))


def _clock(col: str) -> Column:
    return F.date_format(col, "HH:mm:ss")


def _seconds() -> Column:
    return fixed(duration_s(), 0)


def reasoning() -> Column:
    """Types that list all their sources here have exactly one."""
    ips, user, n = _ips(5, "unknown source"), _user("unknown user"), c("total_events")
    first, last, secs = _clock("first_seen"), _clock("last_seen"), _seconds()
    opening = by_type({
        "Brute Force Attack": text(
            "The source IP ", ips, " generated ", n, " failed SSH login attempts between ", first, " and ", last, " (", secs,
            " seconds). This volume and frequency of authentication failures from a single source strongly indicates an "
            "automated brute-force attack."),
        "Account Compromise": text(
            "The source IP ", ips, " made multiple failed authentication attempts targeting user '", user,
            "', followed by a successful login at ", last, ". The pattern of repeated failures immediately preceding a success "
            "indicates a high probability of credential compromise through brute-force."),
        "Web Reconnaissance": text(
            "The source IP ", ips, " probed multiple unique paths on the web server within a short time window (", first, " to ",
            last, "). This systematic enumeration pattern is consistent with automated directory scanning or vulnerability "
            "assessment tooling."),
        "Privilege Escalation Sequence": text(
            "User '", user, "' executed privilege escalation commands between ", first, " and ", last, ". ", n,
            " escalation events were recorded. This activity should be verified as authorized."),
        "Repeated Service Failure": text(
            "A system service experienced ", n, " failures between ", first, " and ", last, " (", secs,
            " seconds). Repeated crashes within a short window may indicate resource exhaustion, malicious input, or a "
            "denial-of-service condition."),
    }, text("A security event of type '", c("incident_type"), "' was detected involving ", ips, ". ", n,
            " related events were observed between ", first, " and ", last, "."))
    rules = F.when(F.size("triggered_rules") > 0, F.array_join("triggered_rules", ", ")).otherwise("none")
    mitre = F.when(F.size("mitre_techniques") > 0, F.array_join("mitre_techniques", ", ")).otherwise("N/A")
    detail = text("Detection was triggered by rules: ", rules, ". MITRE ATT&CK techniques: ", mitre, ".")
    why = F.when(c("correlation_explanation") != "", c("correlation_explanation"))
    return F.concat_ws("\n\n", opening, detail, why)


def recommendations() -> Column:
    def lits(values) -> Column:
        return F.array(*[F.lit(v) for v in values])
    base = by_type({k: lits(v) for k, v in dims.RECOMMENDATIONS.items()}, lits(dims.DEFAULT_RECOMMENDATIONS))
    out = base
    for severity, urgent in dims.URGENT.items():
        out = F.when(c("severity") == severity, F.concat(lits([urgent]), base)).otherwise(out)
    return out


def _recommendation(action, priority, reason, impact) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in
                      zip(("action", "priority", "reason", "impact"), (action, priority, reason, impact))])


def smart_recommendations() -> Column:
    def lits(rows) -> Column:
        return F.array(*[_recommendation(*r) for r in rows])
    base = by_type({k: lits(v) for k, v in dims.SMART_RECOMMENDATIONS.items()}, lits(dims.DEFAULT_SMART_RECOMMENDATIONS))
    listed = F.when(c("severity") == "CRITICAL", F.concat(lits([dims.SMART_URGENT]), base)).otherwise(base)
    progress = c("attack_chain_progress")
    chain = _recommendation(
        text("Attack chain ", fixed(progress, 0), "% complete — prioritize containment"), "CRITICAL",
        text("Attacker has progressed through ", F.size("attack_chain_stages_completed"), " stages"), dims.SMART_CHAIN_IMPACT)
    second = F.concat(F.slice(listed, 1, 1), F.array(chain), F.slice(listed, 2, 100))
    return F.when(progress > 50, second).otherwise(listed)


def root_cause() -> Column:
    ips, user, n = _ips(3, "unknown source"), _user("unknown user"), c("total_events")
    first, last, secs = _clock("first_seen"), _clock("last_seen"), _seconds()
    rate = fixed(n / F.greatest(duration_s(), F.lit(0.1)), 1)
    return by_type({
        "Brute Force Attack": text(
            "Repeated authentication failures (", n, " attempts) from ", ips, " over ", secs, " seconds indicate an automated "
            "brute-force tool systematically guessing credentials. The attack density (", rate, " attempts/sec) confirms "
            "non-human origin. Root cause: externally-facing SSH service without rate limiting or account lockout policy."),
        "Account Compromise": text(
            "Successful authentication from ", ips, " immediately following multiple failed attempts targeting user '", user,
            "' indicates credential compromise through brute-force. The attacker gained valid credentials after sustained "
            "password guessing. Root cause: weak or reused password on account '", user, "' combined with absence of "
            "multi-factor authentication."),
        "Web Reconnaissance": text(
            "Systematic probing of ", n, " web paths from ", ips, " within ", secs, " seconds indicates automated directory "
            "enumeration. The attacker is mapping the application's attack surface before attempting exploitation. Root cause: "
            "web server exposes enumerable endpoints without WAF-level rate limiting or path-based access controls."),
        "Privilege Escalation Sequence": text(
            "User '", user, "' executed ", n, " privilege escalation commands between ", first, " and ", last, ". This may "
            "indicate a compromised account being used to escalate from standard to administrative access. Root cause: overly "
            "permissive sudo configuration or compromised credentials for a user with escalation rights."),
        "Repeated Service Failure": text(
            "Service experienced ", n, " failures in ", secs, " seconds. Repeated crashes in rapid succession may indicate "
            "resource exhaustion, malicious input causing segfaults, or a deliberate denial-of-service attack. Root cause: "
            "service lacks input validation or resource limits, or is under active DoS attack."),
    }, text("Security event '", c("incident_type"), "' involving ", ips, " generated ", n, " related events between ", first,
            " and ", last, ". Detection rules ", _first("triggered_rules", 3), " triggered on correlated activity. Root cause "
            "requires further investigation of the triggering conditions."))


def executive_summary() -> Column:
    needed = F.when(c("severity").isin("CRITICAL", "HIGH"), "required").otherwise("recommended")
    return text(
        "A ", c("severity"), "-severity ", c("incident_type"), " incident was detected with ", c("confidence").cast("string"),
        "% confidence. The attack originated from ", _ips(2, "unknown"), " targeting ", _user("N/A"), ". ", c("total_events"),
        " events were correlated across ", F.size("triggered_rules"), " detection rules. Immediate investigation and response are ",
        needed, ".")


def technical_summary() -> Column:
    mitre = F.when(F.size("mitre_techniques") > 0, _first("mitre_techniques", 5)).otherwise("None mapped")
    return text(
        "Incident ", c("incident_key"), ": ", c("incident_type"), " | Severity: ", c("severity"), " | Confidence: ",
        c("confidence").cast("string"), "% | Risk: ", c("risk"), " | Events: ", c("total_events"), " | Duration: ", _seconds(),
        "s | Rules: ", _first("triggered_rules", 5), " | MITRE ATT&CK: ", mitre, " | Sources: ", _first("first_sources", 5),
        " | Target: ", _user("N/A"))


def mitre_summary() -> Column:
    names = F.create_map(*[F.lit(x) for kv in dims.TECHNIQUES.items() for x in kv])
    lines = F.transform("mitre_techniques", lambda t: F.concat(
        F.lit("  • "), t, F.lit(": "), F.coalesce(names[t], F.lit(dims.UNKNOWN_TECHNIQUE))))
    listed = F.concat_ws("\n", F.lit("MITRE ATT&CK Techniques:"), lines)
    return F.when(F.size("mitre_techniques") == 0, "No MITRE ATT&CK techniques mapped for this incident.").otherwise(listed)


def narrative_line() -> Column:
    return text("  [", F.date_format("timestamp", "HH:mm:ss"), "] ", c("description"))


def speed_finding() -> Column:
    """Null unless the incident is short and busy."""
    n, d = c("total_events"), duration_s()
    return F.when((n >= 10) & (d < 60), text(
        "Attack generated ", n, " events in ", fixed(d, 0), "s (", fixed(n / F.greatest(d, F.lit(0.1)), 1),
        " events/sec), indicating high-speed automated attack."))


def duration_label(a: Column, b: Column) -> Column:
    """Distance of two times as h m, m s or s."""
    s = F.floor(F.abs(F.unix_millis(b) - F.unix_millis(a)) / 1000)
    m = F.floor(s / 60)
    h = F.floor(m / 60)
    return (F.when(a.isNull() | b.isNull(), "—").when(s < 60, text(s, "s")).when(m < 60, text(m, "m ", s % 60, "s"))
            .otherwise(text(h, "h ", m % 60, "m")))


def affected_services(description: Column) -> Column:
    """Known services named in timeline texts. All texts of an incident name the same subject, so one stands for all."""
    names = F.array(*[F.lit(s) for s in dims.TIMELINE_SERVICES])
    return F.filter(names, lambda s: F.contains(F.lower(description), s))

"""Scores of an incident as columns over its row. All steps and weights are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkwarden import dims
from sparkwarden.functions.rounding import round_exact


def steps(x: Column, limits: list[tuple[float, float]], beyond: float, at_least: bool = False) -> Column:
    """Value of the first limit that holds: x <= limit, or x >= limit."""
    out = None
    for limit, value in limits:
        cond = (x >= limit) if at_least else (x <= limit)
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out.otherwise(F.lit(beyond))


def duration_s() -> Column:
    return (F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 1e6


def signal_count() -> Column:
    return F.size("triggered_rules") + F.size("mitre_techniques") + F.col("ip_count")


def event_count_points(n: Column) -> Column:
    return steps(n, [(1, 10.0), (3, 30.0), (5, 50.0), (10, 70.0), (20, 85.0)], 100.0)


def rule_certainty_points(severity: Column) -> Column:
    out = F.lit(30.0)
    for name, points in [("INFO", 15.0), ("LOW", 30.0), ("MEDIUM", 55.0), ("HIGH", 80.0), ("CRITICAL", 100.0)]:
        out = F.when(severity == name, points).otherwise(out)
    return out


def signal_points(n: Column) -> Column:
    return steps(n, [(6, 100.0), (4, 80.0), (2, 55.0)], 25.0, at_least=True)


def density_points() -> Column:
    n, d = F.col("total_events"), duration_s()
    rate = n / d
    return (F.when(n < 2, 20.0).when(d <= 0, 100.0)
            .otherwise(steps(rate, [(1.0, 100.0), (0.5, 85.0), (0.1, 60.0), (0.01, 40.0)], 20.0, at_least=True)))


def confidence() -> Column:
    raw = (event_count_points(F.col("total_events")) * 0.30 + density_points() * 0.25
           + rule_certainty_points(F.col("severity")) * 0.25 + signal_points(signal_count()) * 0.20)
    return F.bround(F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0)), 1)


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for name, rank in dims.SEVERITY_RANK.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def risk() -> Column:
    score = severity_rank(F.col("severity")) * 20 + F.least(F.col("total_events") * 3, F.lit(30)) + F.col("confidence") * 0.5
    return steps(score, [(86, "CRITICAL"), (61, "HIGH"), (31, "MEDIUM")], "LOW", at_least=True)


def threat_factors() -> dict[str, tuple[Column, float]]:
    """Factor and weight, in the order they are added up."""
    n, d, ips = F.col("total_events"), duration_s(), F.col("ip_count")
    rules, mitre = F.size("triggered_rules"), F.size("mitre_techniques")

    def capped(x: Column) -> Column:
        return F.least(x, F.lit(100)).cast("double")
    severity = F.lit(30.0)
    for name, points in [("INFO", 10.0), ("LOW", 30.0), ("MEDIUM", 55.0), ("HIGH", 80.0), ("CRITICAL", 100.0)]:
        severity = F.when(F.col("severity") == name, points).otherwise(severity)
    stage = F.lit(30.0)
    for name, points in dims.STAGE_SCORE.items():
        stage = F.when(F.col("attack_chain_stage") == name, float(points)).otherwise(stage)
    density = (F.when(d <= 0, F.when(n > 1, 100.0).otherwise(20.0))
               .otherwise(steps(n / d, [(1.0, 100.0), (0.5, 85.0), (0.1, 60.0)], 30.0, at_least=True)))
    return {
        "rule_severity": (severity, 0.15),
        "evidence_quality": (capped(n * 8), 0.12),
        "ioc_quality": (capped((ips + mitre) * 15), 0.08),
        "correlation_strength": (capped((rules + mitre + ips) * 12), 0.12),
        "attack_stage": (stage, 0.10),
        "attack_progress": (capped(F.col("attack_chain_progress")), 0.08),
        "time_density": (density, 0.10),
        "source_diversity": (capped(ips * 25), 0.08),
        "rule_diversity": (capped(rules * 20), 0.10),
        "event_volume": (capped(n * 5), 0.07),
    }


def threat_breakdown() -> Column:
    return F.struct(*[f.alias(name) for name, (f, _) in threat_factors().items()])


def threat_score() -> Column:
    """From the column threat_score_breakdown; added from left to right, then rounded by exact value."""
    total = F.lit(0.0)
    for name, (_, weight) in threat_factors().items():
        total = total + F.col("threat_score_breakdown")[name] * weight
    return round_exact(F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0)), 1)

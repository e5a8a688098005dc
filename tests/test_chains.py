"""A rule of an earlier chain takes an incident over, whatever its own type says."""

from sparkwarden import Config, Engine


def chain_of(spark, values, lines, key):
    e = Engine(spark, lines(values), Config(year=2024))
    r = e.all_incidents.where(f"incident_key = '{key}'").first()
    return r.attack_chain_id, r.attack_chain_stage, r.attack_chain_stages_completed


def test_crash_texts_in_missing_pages_belong_to_the_web_chain(spark, lines):
    values = [f'1.2.3.4 - - [01/Jul/2024:10:00:{i // 2:02d} +0000] "GET /abort{i} HTTP/1.1" 404 200 "-" "x"' for i in range(40)]
    chain, stage, done = chain_of(spark, values, lines, "service_fail:apache")
    assert (chain, stage) == ("CHAIN-web_attack:1.2.3.4", "enumeration") and done == ["enumeration"]


def test_a_crash_alone_stays_a_disruption(spark, lines):
    values = [f"Jul  1 10:00:{i:02d} prod-01 svc1[77]: worker segfault at 0" for i in range(5)]
    chain, stage, _ = chain_of(spark, values, lines, "service_fail:svc1")
    assert chain is None and stage == ""  # no source and no user, so no attacker to name a chain after

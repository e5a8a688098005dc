"""Merging of incidents that belong together.

Two open incidents merge when the last time of the earlier-listed one is within merge_window_s of the first time of the
other, and they share a source and a user, or a chain, or a source and a type. A merged incident takes part on with its
grown time range and sources, so the order of the list matters.

The merging runs in rounds of joins on slim rows (keys and times; no events or texts), see merge_map; no group of incidents
is ever gathered, however long an address is active.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.config import Config
from sparkwarden.operators.ordered import SECOND, Running, first_rows, with_totals

c = F.col
OPEN = ["ACTIVE", "INVESTIGATING"]


def open_incidents(incidents: DataFrame) -> DataFrame:
    return incidents.where(c("status").isin(OPEN)).select(
        "incident_key", "incident_type", "target_user", "attack_chain_id", "admitted_pos",
        F.unix_micros("first_seen").alias("first_t"), F.unix_micros("last_seen").alias("last_t"))


def links(slim: DataFrame, sources: DataFrame) -> DataFrame:
    by_ip = slim.select("incident_key").join(sources, "incident_key").select(
        "incident_key", F.concat(F.lit("ip:"), "source_ip").alias("link"))
    by_chain = slim.where("attack_chain_id is not null").select("incident_key", c("attack_chain_id").alias("link"))
    return by_ip.unionByName(by_chain)


def merge_candidates(incidents: DataFrame, sources: DataFrame, config: Config) -> DataFrame:
    """Pairs (earlier in the list, later) that would merge as they stand.

    The times are cut into slots of the window's width, so the joins only meet pairs that are near in time.
    """
    width = config.merge_window_s * SECOND
    slim = open_incidents(incidents)
    with_ip = slim.join(sources.select("incident_key", "source_ip"), "incident_key")
    user = with_ip.where("target_user <> ''").withColumn("link", F.concat_ws("|", F.lit("user"), "source_ip", "target_user"))
    kind = with_ip.withColumn("link", F.concat_ws("|", F.lit("type"), "source_ip", "incident_type"))
    chain = slim.where("attack_chain_id is not null").withColumn("link", F.concat_ws("|", F.lit("chain"), "attack_chain_id"))
    cols = ["incident_key", "admitted_pos", "first_t", "last_t", "link"]
    keyed = user.select(*cols).unionByName(kind.select(*cols)).unionByName(chain.select(*cols))
    a = keyed.select("link", c("incident_key").alias("primary_key"), c("admitted_pos").alias("a_pos"), "last_t",
                     F.explode(F.array(*[F.floor(c("last_t") / width) + i for i in (-1, 0, 1)])).alias("slot"))
    b = keyed.select("link", c("incident_key").alias("secondary_key"), c("admitted_pos").alias("b_pos"), "first_t",
                     F.floor(c("first_t") / width).alias("slot"))
    return (a.join(b, ["link", "slot"]).where((c("a_pos") < c("b_pos")) & (F.abs(c("last_t") - c("first_t")) <= width))
            .select("primary_key", "secondary_key").distinct())


def _moment(pos) -> list:
    """A list position as (t, seq) for ordered totals; members lie behind those who ask at the same position."""
    return [pos["t"].alias("pt"), ((pos["seq"] * 8 + pos["ord"]) * 2).alias("ps")]


def _keys(d: DataFrame, ips: DataFrame, at: list[str], user: str = "target_user") -> DataFrame:
    """What rows (incident_key, incident_type, user, attack_chain_id) share to be alike: source and user, source and type, chain.

    ips: (incident_key, source_ip, ...). `at` are columns to keep, from either side."""
    with_ip = d.join(ips, "incident_key")
    by_type = with_ip.select("incident_key", F.concat_ws("|", F.lit("type"), "source_ip", "incident_type").alias("link"), *at)
    by_user = with_ip.where(c(user) != "").select("incident_key", F.concat_ws("|", F.lit("user"), "source_ip", user).alias("link"), *at)
    return by_type.unionByName(by_user)


def _roots(parents: DataFrame, cut, name: str) -> DataFrame:
    """(incident_key, owner) from (incident_key, owner) where an owner may have an owner in turn: paths are halved until none is left."""
    i = 0
    while True:
        up = parents.select(c("incident_key").alias("owner"), c("owner").alias("far"))
        step = cut(f"{name}_{i}", parents.join(up, "owner", "left").select(
            "incident_key", F.coalesce("far", "owner").alias("owner"), (F.coalesce("far", "owner") != c("owner")).alias("moved")))
        parents, i = step.select("incident_key", "owner"), i + 1
        if not step.where("moved").take(1):
            return parents


def _first_guess(slim: DataFrame, ips: DataFrame, width: int) -> DataFrame:
    """Each incident with the earliest one that shares a key and ended in the slot of its start or beside it, else with itself."""
    slot = lambda t, i=0: F.floor(c(t) / width) + i
    chain = slim.where("attack_chain_id is not null").withColumn("link", F.concat_ws("|", F.lit("chain"), "attack_chain_id"))
    cols = ["first_t", "last_t", "pos"]
    keyed = _keys(slim, ips, cols).unionByName(chain.select("incident_key", "link", *cols))
    earliest = keyed.groupBy("link", slot("last_t").alias("slot")).agg(F.min(F.struct("pos", "incident_key")).alias("a"))
    asked = keyed.select("incident_key", "pos", "link", F.explode(F.array(*[slot("first_t", i) for i in (-1, 0, 1)])).alias("slot"))
    best = (asked.join(earliest, ["link", "slot"]).where("a.pos < pos").groupBy("incident_key").agg(F.min("a").alias("a")))
    return slim.join(best, "incident_key", "left").select("incident_key", F.coalesce("a.incident_key", "incident_key").alias("owner"))


def _nodes(lo, hi, levels: int):
    """The dyadic nodes (level, number) that make up the slots lo to hi: at most two a level."""
    def of(k: int):
        width = 1 << k
        # Of this level are the nodes at the edges of the range that the next level cannot hold.
        a, b = F.ceil(lo / width), F.floor((hi + 1) / width) - 1
        whole = [F.when((a <= b) & (F.pmod(a, F.lit(2)) == 1), a), F.when((a <= b) & (F.pmod(b, F.lit(2)) == 0), b)]
        if k == levels - 1:
            return F.transform(F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>")), lambda x: F.struct(F.lit(k).alias("k"), x.cast("bigint").alias("node")))
        return F.transform(F.array_compact(F.array_distinct(F.array(*whole))), lambda x: F.struct(F.lit(k).alias("k"), x.cast("bigint").alias("node")))
    return F.concat(*[of(k) for k in range(levels)])


LEVELS = 12


def _owners(slim: DataFrame, ips: DataFrame, guess: DataFrame, width: int, cut, name: str) -> DataFrame:
    """(incident_key, owner): whom the list would give each incident to, were the rest of it merged as guessed.

    Asked is the earliest incident in the list that is its own owner, shares a key with the one asking as of its position (with
    what it took over before), and ended then within the window of its start. Primaries are found by key and by the slots of
    time that they hold the key (dyadic ranges, so no two rows meet for being in one hot key); each pair then reads the
    primary's last time as of the position.
    """
    slot = lambda t: F.floor(t / width)
    members = cut(f"{name}_members", slim.join(guess, "incident_key"))
    heads = members.where("incident_key = owner").select(c("incident_key").alias("owner"), c("incident_type").alias("type"), c("attack_chain_id").alias("chain"),
                                                         c("pos").alias("head"), c("last_t").alias("own_last"))
    mine = members.join(heads.select("owner"), "owner", "left_semi")
    grown = mine.groupBy("owner").agg(F.max("last_t").alias("end"), F.min(F.when(c("target_user") != "", F.struct("pos", "target_user"))).alias("user"))
    heads = cut(f"{name}_heads", heads.join(grown, "owner"))
    held = (mine.select("incident_key", "owner", "pos", "last_t").join(ips, "incident_key").groupBy("owner", "source_ip")
            .agg(F.min(F.struct("pos", "last_t")).alias("got")))
    at = ["head", "since", "from_t", "end"]
    owned = heads.select(c("owner").alias("incident_key"), c("type").alias("incident_type"), "user", "head", "own_last", "end")
    with_ip = owned.join(held.select(c("owner").alias("incident_key"), "source_ip", "got"), "incident_key").withColumn(
        "from_t", F.greatest("own_last", "got.last_t"))
    offers = with_ip.select("incident_key", F.concat_ws("|", F.lit("type"), "source_ip", "incident_type").alias("link"), "head", c("got.pos").alias("since"), "from_t", "end")
    offers = offers.unionByName(with_ip.where("user is not null").select(
        "incident_key", F.concat_ws("|", F.lit("user"), "source_ip", "user.target_user").alias("link"), "head",
        F.greatest("got.pos", "user.pos").alias("since"), "from_t", "end"))
    offers = offers.unionByName(heads.where("chain is not null").select(
        c("owner").alias("incident_key"), F.concat_ws("|", F.lit("chain"), "chain").alias("link"), "head", c("head").alias("since"), c("own_last").alias("from_t"), "end"))
    offers = offers.select(c("incident_key").alias("owner"), "link", *at[:2], F.explode(_nodes(slot(c("from_t")) - 1, slot(c("end")) + 1, LEVELS)).alias("n"))
    chained = slim.where("attack_chain_id is not null").select("incident_key", F.concat_ws("|", F.lit("chain"), "attack_chain_id").alias("link"), "pos", "first_t")
    asked = _keys(slim, ips, ["pos", "first_t"]).unionByName(chained)
    asked = asked.select("incident_key", "link", "pos", "first_t", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.floor(slot(c("first_t")) / (1 << k)).cast("bigint").alias("node")) for k in range(LEVELS)])).alias("n"))
    pairs = (asked.join(offers, ["link", "n"]).where((c("head") < c("pos")) & (c("since") < c("pos")))
             .select("incident_key", "owner", "pos", "first_t", "head").distinct())
    told = mine.select(F.lit(None).cast("string").alias("incident_key"), "owner", *_moment(c("pos")), "last_t",
                       F.lit(None).cast("bigint").alias("first_t"), F.lit(None).cast(dict(slim.dtypes)["pos"]).alias("head"))
    told = told.withColumn("ps", c("ps") + 1)
    asking = pairs.select("incident_key", "owner", *_moment(c("pos")), F.lit(None).cast("bigint").alias("last_t"), "first_t", "head")
    seen = with_totals(cut(f"{name}_asked", told.unionByName(asking)), ["owner"], {"last": Running(c("last_t"), "max")}, t="pt", seq="ps")
    near = seen.where(c("incident_key").isNotNull() & (F.abs(c("last") - c("first_t")) <= width))
    found = near.groupBy("incident_key").agg(F.min(F.struct("head", "owner")).alias("a"))
    return cut(f"{name}_owners", slim.join(found, "incident_key", "left").select("incident_key", F.coalesce("a.owner", "incident_key").alias("owner")))


def merge_map(incidents: DataFrame, sources: DataFrame, config: Config, cut) -> DataFrame:
    """(incident_key, primary_key, merge_ord) of the incidents that were absorbed.

    Where an incident goes depends only on those before it in the list. So a map of owners that gives itself, when every
    incident is asked again under it, is the list's own: rounds go on from a guess until nothing changes. Each makes at
    least the first wrong row right, and mostly all of a chain of merges, since owners of owners are followed up.
    cut(name, df) writes a table. The driver reads whether a row changed, nothing else.
    """
    width = config.merge_window_s * SECOND
    slim = open_incidents(incidents).withColumn("pos", F.struct("admitted_pos.t", "admitted_pos.seq", "admitted_pos.ord")).drop("admitted_pos")
    own_ips = sources.select("incident_key", "source_ip").distinct()
    # Only incidents that share a source or a chain with another one can merge.
    linked = links(slim, own_ips)
    shared = linked.groupBy("link").agg(F.min("incident_key").alias("a"), F.max("incident_key").alias("b")).where("a <> b")
    some = linked.join(shared, "link", "left_semi").select("incident_key").distinct()
    slim = cut("merge_slim", slim.join(some, "incident_key", "left_semi"))
    ips = cut("merge_ips", own_ips.join(slim.select("incident_key"), "incident_key", "left_semi"))
    owners = cut("merge_guess", _first_guess(slim, ips, width))
    n = 0
    while True:
        owners = _roots(owners, cut, f"merge_{n}_roots")
        now = _owners(slim, ips, owners, width, cut, f"merge_{n}")
        changed = now.join(owners, ["incident_key", "owner"], "left_anti")
        if not changed.take(1):
            break
        owners, n = now, n + 1
    taken = slim.join(owners.where("incident_key <> owner"), "incident_key").select("incident_key", c("owner").alias("primary_key"), *_moment(c("pos")))
    return with_totals(taken, ["primary_key"], {"merge_ord": Running(F.lit(1))}, t="pt", seq="ps").select(
        "incident_key", "primary_key", c("merge_ord").cast("int").alias("merge_ord"))


def merged_incidents(incidents: DataFrame, sources: DataFrame, absorbed: DataFrame,
                     updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(incidents after merging, their sources). Absorbed incidents stay as CLOSED rows with is_merged.

    Scores are not recomputed. Lists are united in merge order through their elements, so none is gathered whole.
    """
    every = incidents.join(absorbed, "incident_key", "left").withColumn("owner", F.coalesce("primary_key", "incident_key"))
    every = every.withColumn("merge_ord", F.coalesce("merge_ord", F.lit(0)))
    rank = F.expr("case severity when 'CRITICAL' then 4 when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 else 0 end")
    has_user = F.when(c("target_user") != "", c("merge_ord"))
    totals = every.groupBy("owner").agg(
        F.sum("total_events").alias("total_events"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.max_by("severity", F.struct(rank.alias("r"), -c("merge_ord"))).alias("severity"),
        F.min_by("target_user", has_user).alias("target_user"), F.count_if(c("merge_ord") > 0).alias("merged_count"))

    def united(column: str) -> DataFrame:
        items = every.select("owner", "merge_ord", F.posexplode(column).alias("i", "x"))
        firsts = items.groupBy("owner", "x").agg(F.min(F.struct("merge_ord", "i")).alias("at"))
        return (firsts.groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("l"))
                .select("owner", F.transform("l", lambda v: v["x"]).alias(column)))
    owner_of = every.select("incident_key", "owner", "merge_ord")
    ips = (sources.join(owner_of, "incident_key").groupBy("owner", "source_ip")
           .agg(F.min(F.struct("merge_ord", "first_pos")).alias("at")))
    shown = (first_rows(ips, ["owner"], ["at"], 5).groupBy("owner")
             .agg(F.sort_array(F.collect_list(F.struct("rn", "source_ip"))).alias("l"))
             .select("owner", F.transform("l", lambda v: v["source_ip"]).alias("first_sources")))
    # One line can update several incidents; its alerts count once in the incident that unites them.
    uniting = every.where("merge_ord > 0").select("owner").distinct()
    alerts = (updates.join(owner_of.join(uniting, "owner"), "incident_key").select("owner", "seq", F.explode("hits.rule_id").alias("rule_id"))
              .distinct().groupBy("owner").agg(F.count("*").alias("alert_count")))
    ip_count = ips.groupBy("owner").agg(F.count("*").alias("ip_count"))
    new = totals
    for part in (united("triggered_rules"), united("mitre_techniques"), shown, ip_count, alerts):
        new = new.join(part, "owner", "left")
    changed = [x for x in new.columns if x != "owner"]
    new = new.select("owner", *[c(x).alias(f"_{x}") for x in changed])
    is_merged = c("merge_ord") > 0
    d = every.join(new, "owner")
    grown = ~is_merged & (c("_merged_count") > 0)
    for x in changed:
        d = d.withColumn(x, F.when(grown, c(f"_{x}")).otherwise(c(x)) if x != "merged_count"
                         else F.when(is_merged, F.lit(0).cast("bigint")).otherwise(c("_merged_count")))
    nothing = F.array().cast("array<string>")
    d = (d.withColumn("is_merged", is_merged).withColumn("status", F.when(is_merged, "CLOSED").otherwise(c("status")))
         .withColumn("first_sources", F.coalesce("first_sources", nothing)).withColumn("ip_count", F.coalesce("ip_count", F.lit(0))))
    out_sources = (ips.select(c("owner").alias("incident_key"), "source_ip", c("at.first_pos").alias("first_pos"),
                              c("at.merge_ord").alias("merge_ord")))
    return d.select(*incidents.columns, "is_merged", "primary_key", "merged_count"), out_sources


def rank_priority(incidents: DataFrame) -> DataFrame:
    """Queue position of the incidents that were not merged away: by score, ties in list order.

    Numbering a whole table needs no single task: counts per score are summed first, and ties are numbered per score.
    """
    live = incidents.where(~c("is_merged"))
    per_score = live.groupBy("threat_score").agg(F.count("*").alias("n"))
    # Scores have one decimal between 0 and 100, so there are at most 1001 of them.
    above = per_score.select("threat_score", F.coalesce(F.sum("n").over(
        Window.orderBy(c("threat_score").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    t = live.select("*", c("admitted_pos.t").alias("_t"), (c("admitted_pos.seq") * 8 + c("admitted_pos.ord")).alias("_seq"))
    tied = with_totals(t, ["threat_score"], {"_place": Running(F.lit(1))}, t="_t", seq="_seq")
    return (tied.join(F.broadcast(above), "threat_score").withColumn("priority", (c("above") + c("_place")).cast("int"))
            .drop("above", "_place", "_t", "_seq"))

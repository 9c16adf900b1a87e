"""Phased roadmap: placement, prerequisite hoisting, ordering and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import case, lookup, spread_nulls
from ..knowledge import algorithms as kb
from ..knowledge import policy as pol
from ..knowledge.tables import dimension
from ..session import drop_stage, write_stage
from .impact import pki_pairs, with_gates
from .risk import tagged

ITEMS_PER_PHASE = 60
TOP_PER_BAND = 15
OUT_OF_SCOPE = ("false-positive", "dismissed")


def in_scope(assets: DataFrame) -> DataFrame:
    return assets.where(~F.col("triage_state").isin(*OUT_OF_SCOPE))


def placement() -> Column:
    """struct(phase, reason); the precedence is fixed."""
    def out(phase, reason):
        return F.struct(F.lit(phase).alias("phase"), F.lit(reason).alias("reason"))

    c = F.col
    s, d = c("recommended_strategy"), c("migration_decision")
    migrates = d.isin("HYBRID", "PQC-ONLY")
    unknown_role = (c("cryptographic_role") == kb.UNKNOWN) & c("quantum_vulnerable")
    pilot = ((c("pqc_readiness") == "native") & (c("crypto_agility") == "high")
             & (F.coalesce("business_criticality", F.lit("")) != "mission-critical"))
    classify = s.isin("verify-manually", "determine-role-then-migrate")
    return case(
        (classify & unknown_role, out("PH1", "role-unresolved")),
        (classify, out("PH1", "needs-confirmation")),
        (c("quantum_class") == kb.BROKEN, out("PH2", "classically-broken")),
        (c("days_to_expiry") < 0, out("PH2", "certificate-expired")),
        (tagged("key-material-exposure"), out("PH2", "key-exposed")),
        (d == "UPGRADE", out("PH2", "decision-upgrade")),
        (s.isin("renew-certificate", "rotate-and-externalise-key"), out("PH2", "operational-exposure")),
        (c("unblocks") > 0, out("PH3", "unblocks-others")),
        (s.isin("upgrade-protocol", "strengthen-parameters"), out("PH3", "structural-strategy")),
        ((c("crypto_agility") == "low") & c("quantum_vulnerable"), out("PH3", "low-agility")),
        (migrates & pilot, out("PH4", "pilot-candidate")),
        (migrates, out("PH5", "named-target")),
        (d == "HARDEN", out("PH3", "decision-harden")),
        otherwise=out("PH5", "other"))


def issuer_jumps(pairs: DataFrame, live: DataFrame) -> list[DataFrame]:
    """(asset_id, prereq_id) 1, 2, 4, ... steps apart along issuers that are live items. A
    chain of n issuers has log2(n) tables; a cycle ends with the number of issuers."""
    ids = live.where("is_issuer").select("asset_id")
    step = pairs.select("asset_id", "prereq_id").join(ids, "asset_id", "left_semi").join(ids.select(F.col("asset_id").alias("prereq_id")), "prereq_id", "left_semi")
    jump = write_stage(step.select("asset_id", "prereq_id").distinct(), "hoist-jump")
    out, most = [], ids.count().bit_length()
    while not jump.isEmpty():
        out.append(jump)
        if len(out) >= most:
            break
        ahead = jump.select(F.col("asset_id").alias("prereq_id"), F.col("prereq_id").alias("further"))
        jump = write_stage(jump.join(ahead, "prereq_id").select("asset_id", F.col("further").alias("prereq_id")).distinct(), "hoist-jump")
    return out


def hoist(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """(asset_id, hoisted phase number): a blocker inherits the earliest implementation
    phase of anything it blocks, to the fixpoint. PH1 is exempt on both sides. Phases only
    fall, so the rounds end.

    Minima are taken per library, protocol and issuer, never over pairs. Only gating
    items can move, so the other items are reduced to their minima once and each round
    works on the gating ones alone. Along issuers a round climbs by doubled steps, so a
    chain of any depth takes as many joins as its depth has bits.
    """
    live = items.where("phase <> 'PH1'").select(
        "asset_id", "library_node", "protocol_node", "is_provider", "is_gate", "waits",
        F.expr("CAST(substr(phase, 3) AS INT)").alias("n"))
    issuers = pairs.select(F.col("prereq_id").alias("asset_id")).distinct().withColumn("is_issuer", F.lit(True))
    live = live.join(issuers, "asset_id", "left").withColumn("is_issuer", F.coalesce("is_issuer", F.lit(False)))
    live = write_stage(live.withColumn("moves", F.expr("is_provider OR is_gate OR is_issuer")), "hoist-items")
    fixed, state = live.where("NOT moves"), live.where("moves")
    jumps = issuer_jumps(pairs, live)

    def minima(df):
        libs = df.where("library_node IS NOT NULL").groupBy("library_node").agg(F.min("n").alias("lib_n"))
        protos = df.where("waits").groupBy("protocol_node").agg(F.min("n").alias("proto_n"))
        issued = (pairs.select("asset_id", "prereq_id").join(df.select("asset_id", "n"), "asset_id")
                  .groupBy("prereq_id").agg(F.min("n").alias("pki_n")))
        return libs, protos, issued

    static = [write_stage(m, "hoist-min") for m in minima(fixed)]
    before = live
    while True:
        libs, protos, issued = [
            s.unionByName(m).groupBy(s.columns[0]).agg(F.min(s.columns[1]).alias(s.columns[1]))
            for s, m in zip(static, minima(state))]
        nxt = (state.join(libs.withColumnRenamed("library_node", "lib"), spread_nulls(F.col("library_node"), F.col("asset_id")) == F.col("lib"), "left")
               .join(protos.withColumnRenamed("protocol_node", "proto"), spread_nulls(F.col("protocol_node"), F.col("asset_id")) == F.col("proto"), "left")
               .join(issued.withColumnRenamed("prereq_id", "asset_id"), "asset_id", "left"))
        best = F.least("n", F.when(F.col("is_provider"), F.col("lib_n")),
                       F.when(F.col("is_gate"), F.col("proto_n")), F.col("pki_n"))
        columns = [c for c in state.columns if c != "n"]
        after = write_stage(nxt.select(*columns, best.alias("n"), (best < F.col("n")).alias("moved")), "hoist-round")
        moved = not after.where("moved").isEmpty()
        drop_stage(before)
        before, state = after, after.drop("moved")
        if not moved:
            break
        for jump in jumps:
            low = jump.join(state.select("asset_id", "n"), "asset_id").groupBy("prereq_id").agg(F.min("n").alias("low"))
            climbed = state.join(low.withColumnRenamed("prereq_id", "asset_id"), "asset_id", "left")
            after = write_stage(climbed.select(*columns, F.least("n", "low").alias("n")), "hoist-climb")
            drop_stage(before)
            before = state = after
    drop_stage(*jumps, *static)
    return state.select("asset_id", F.col("n").alias("hoisted"))


def location() -> Column:
    return (F.when((F.col("file") != "") & (F.coalesce("line", F.lit(0)) != 0),
                   F.concat_ws(":", "file", F.col("line").cast("string")))
            .otherwise(F.coalesce(F.when(F.col("file") != "", F.col("file")),
                                  F.when(F.col("container") != "", F.col("container")), F.col("asset_name"))))


def build_items(impacts: DataFrame) -> DataFrame:
    """One row per scheduled asset, in exactly one phase."""
    scoped = in_scope(impacts).where("coalesce(migration_decision, '') <> 'RETAIN'")
    scoped = scoped.withColumn("p", placement())
    items = scoped.select(
        "asset_id", "asset_name", "application", location().alias("location"),
        F.coalesce("migration_priority", F.lit(0)).alias("priority"),
        F.coalesce("priority_band", F.lit("P3")).alias("band"),
        F.coalesce("mosca_urgency", F.lit("not-applicable")).alias("urgency"),
        F.coalesce("migration_decision", F.lit("undecided")).alias("decision"),
        F.coalesce("recommended_strategy", F.lit("verify-manually")).alias("strategy"),
        F.coalesce("recommended_hybrid", "recommended_pqc").alias("target"),
        F.coalesce("migration_effort", F.lit("moderate")).alias("effort"),
        F.col("migration_months").alias("months"),
        F.col("coordinated_effort_months").alias("coordinated_months"),
        F.coalesce("crypto_agility", F.lit("medium")).alias("agility"),
        F.col("dependency_centrality").alias("centrality"), "blast_radius", "prerequisites",
        "unblocks", F.col("migration_blockers").alias("blockers"), "change_units",
        "first_application", "library_node", "protocol_node", "certificate_node",
        "is_provider", "is_gate", "waits",
        F.col("p.phase").alias("phase"), F.col("p.reason").alias("why"))
    items = write_stage(items, "items")
    moved = hoist(items, pki_pairs(impacts))
    new = F.concat(F.lit("PH"), F.col("hoisted").cast("string"))
    hoisted = F.col("hoisted").isNotNull() & (new != F.col("phase"))
    return write_stage(items.join(moved, "asset_id", "left").withColumns({
        "placed_phase": F.col("phase"), "why_this_phase": F.when(hoisted, F.concat(F.lit("hoisted; was "), "phase", F.lit(" "), "why")).otherwise(F.col("why")),
    }).withColumn("phase", F.coalesce(new, F.col("phase"))).drop("hoisted", "why"), "roadmap")


def ordered(items: DataFrame) -> DataFrame:
    """Execution order; a global sort, so ranges of it can be written in parallel."""
    return items.orderBy("phase", F.desc("unblocks"), F.desc("priority"), "asset_id")


def listed_items(items: DataFrame, limit: int = ITEMS_PER_PHASE) -> DataFrame:
    """Top items of each phase with their rank. The rank filter also runs before the
    shuffle, so a phase holding most of the estate sends only its best rows."""
    w = Window.partitionBy("phase").orderBy(F.desc("unblocks"), F.desc("priority"), "asset_id")
    return items.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def counts_of(items: DataFrame, by: str, value: str, name: str, keep_null: bool = False) -> DataFrame:
    """by -> 'value=count, ...' text from a two-step aggregate."""
    n = items.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(
        "=", value, F.col("n").cast("string")))), ", ").alias(name))


def phase_rollup(items: DataFrame) -> DataFrame:
    """All seven phases; the first and last never hold items."""
    dim = dimension(items.sparkSession, pol.PHASES, ("phase", "phase_name", "duration"))
    agg = items.groupBy("phase").agg(
        F.count(F.lit(1)).alias("asset_count"), F.max("coordinated_months").alias("longest_coordinated_months"),
        *[F.count_if(F.col("band") == b).alias(b.lower()) for b in pol.PRIORITY_BANDS],
        *[F.count_if(F.col("decision") == d).alias(d.lower().replace("-", "_")) for d in pol.DECISIONS if d != "RETAIN"],
        F.sum("unblocks").alias("unblocked"))
    apps = (items.where("application IS NOT NULL").select("phase", "application").distinct()
            .groupBy("phase").agg(F.count(F.lit(1)).alias("applications")))
    out = dim.join(agg, "phase", "left").join(apps, "phase", "left")
    numbers = [c for c in out.columns if c not in ("phase", "phase_name", "duration")]
    return out.fillna(0, numbers).withColumn(
        "items_truncated", F.greatest(F.lit(0), F.col("asset_count") - ITEMS_PER_PHASE))


def band_rollup(items: DataFrame) -> DataFrame:
    dim = dimension(items.sparkSession, [(b,) for b in pol.PRIORITY_BANDS], ("band",))
    agg = items.groupBy("band").agg(F.count(F.lit(1)).alias("assets"),
                                    F.max("coordinated_months").alias("longest_coordinated_months"))
    apps = (items.where("application IS NOT NULL").select("band", "application").distinct()
            .groupBy("band").agg(F.count(F.lit(1)).alias("applications")))
    return (dim.join(agg, "band", "left").join(apps, "band", "left")
            .join(counts_of(items, "band", "decision", "decisions"), "band", "left")
            .join(counts_of(items, "band", "phase", "phases"), "band", "left")
            .fillna(0, ["assets", "longest_coordinated_months", "applications"]).fillna("", ["decisions", "phases"]))


def top_of_band(items: DataFrame, limit: int = TOP_PER_BAND) -> DataFrame:
    w = Window.partitionBy("band").orderBy(F.desc("priority"), "asset_id")
    return items.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def enablement_waves(items: DataFrame, impacts: DataFrame) -> DataFrame:
    """Gating items by fan-out with the distinct first applications of what they unblock.

    Applications are counted per library and per protocol and combined by inclusion and
    exclusion, so no gating asset meets the applications of its resources. Certificate
    issuers add the applications of what they issued, where these are in neither. An asset
    does not unblock itself: an application it alone contributes is taken off again.
    """
    apps = impacts.where("first_application IS NOT NULL")

    def held(node: str, who: str, name: str) -> DataFrame:
        return (apps.where(who).groupBy(F.col(node).alias(name), F.col("first_application").alias("app"))
                .agg(F.count(F.lit(1)).alias("holders"), F.min("asset_id").alias("holder")))

    libs = write_stage(held("library_node", "library_node IS NOT NULL", "lib"), "library-applications")
    protos = write_stage(held("protocol_node", "waits AND protocol_node IS NOT NULL", "proto"), "protocol-applications")
    own = apps.select("asset_id", F.col("first_application").alias("own"))
    gating = items.where("unblocks > 0")
    g = gating.select("asset_id", F.when(F.col("is_provider"), F.col("library_node")).alias("lib"),
                      F.when(F.col("is_gate"), F.col("protocol_node")).alias("proto")).join(own, "asset_id", "left")
    spread = lambda name: spread_nulls(F.col("g." + name), F.col("g.asset_id"))
    both = g.where("lib IS NOT NULL AND proto IS NOT NULL").select("lib", "proto").distinct()
    common = (both.join(libs.select("lib", "app"), "lib").join(protos.select("proto", "app"), ["proto", "app"], "left_semi")
              .groupBy("lib", "proto").agg(F.count(F.lit(1)).alias("n_both")))
    issued = (pki_pairs(impacts).select("asset_id", "prereq_id").join(own, "asset_id")
              .select(F.col("prereq_id").alias("asset_id"), F.col("own").alias("app")).distinct())
    issued = write_stage(issued.join(g.withColumnRenamed("own", "g_own"), "asset_id"), "issuer-applications")
    more = (issued.alias("g").join(libs.select(F.col("lib").alias("x"), F.col("app").alias("y")), (spread("lib") == F.col("x")) & (F.col("g.app") == F.col("y")), "left_anti")
            .alias("g").join(protos.select(F.col("proto").alias("x"), F.col("app").alias("y")), (spread("proto") == F.col("x")) & (F.col("g.app") == F.col("y")), "left_anti")
            .groupBy("asset_id").agg(F.count(F.lit(1)).alias("n_issued")))
    own_issued = issued.where("app = g_own").select("asset_id", F.lit(True).alias("own_issued"))

    def joined(g: DataFrame, name: str, sizes: DataFrame, table: DataFrame) -> DataFrame:
        mine = table.select(F.col(name).alias("x"), F.col("app").alias("y"), "holders", "holder")
        out = g.alias("g").join(sizes, spread(name) == F.col("z"), "left").drop("z")
        out = out.alias("g").join(mine, (spread(name) == F.col("x")) & (F.col("g.own") == F.col("y")), "left")
        others = (F.col("holders") > 1) | (F.col("holder") != F.col("asset_id"))
        return out.withColumns({"in_" + name: F.col("holders").isNotNull(), "others_" + name: F.coalesce(others, F.lit(False))}).drop("x", "y", "holders", "holder")

    count = lambda table, name, n: table.groupBy(F.col(name).alias("z")).agg(F.count(F.lit(1)).alias(n))
    g = joined(g, "lib", count(libs, "lib", "n_lib"), libs)
    g = joined(g, "proto", count(protos, "proto", "n_proto"), protos)
    g = (g.alias("g").join(common.select(F.col("lib").alias("x"), F.col("proto").alias("y"), "n_both"), (spread("lib") == F.col("x")) & (spread("proto") == F.col("y")), "left").drop("x", "y")
         .join(more, "asset_id", "left").join(own_issued, "asset_id", "left"))
    zero = lambda n: F.coalesce(F.col(n), F.lit(0))
    alone = F.expr("(in_lib OR in_proto) AND NOT others_lib AND NOT others_proto AND own_issued IS NULL").cast("int")
    reached = g.select("asset_id", (zero("n_lib") + zero("n_proto") - zero("n_both") + zero("n_issued") - alone).alias("applications"))
    return gating.join(reached, "asset_id", "left").select(
        F.col("asset_id").alias("gating_asset"), F.col("asset_name").alias("gating_asset_name"),
        "phase", "decision", "strategy", "change_units", F.col("unblocks").alias("dependent_assets"),
        F.coalesce("applications", F.lit(0)).cast("bigint").alias("applications"), F.col("coordinated_months").alias("months"))


def application_rollup(impacts: DataFrame, applications: DataFrame) -> DataFrame:
    rank = lookup(F.col("mosca_urgency"), {u: i for i, u in enumerate(pol.URGENCIES)}, 9)
    a = in_scope(impacts).where("application IS NOT NULL")
    agg = a.groupBy("application").agg(
        F.count(F.lit(1)).alias("assets"), F.count_if("quantum_vulnerable").alias("quantum_vulnerable"),
        *[F.count_if(F.col("migration_decision") == d).alias(d.lower().replace("-", "_")) for d in pol.DECISIONS],
        F.count_if(F.col("priority_band") == "P0").alias("p0"), F.count_if(F.col("priority_band") == "P1").alias("p1"),
        F.max("migration_priority").alias("max_priority"),
        F.min_by("mosca_urgency", rank).alias("worst_urgency"),
        F.max("coordinated_effort_months").alias("effort_months"))
    names = applications.select(F.col("app_id").alias("application"), "name", "owner", "business_unit")
    return agg.join(names, "application", "left")


def totals(impacts: DataFrame, items: DataFrame) -> DataFrame:
    scoped = ~F.col("triage_state").isin(*OUT_OF_SCOPE)
    retained = scoped & (F.coalesce("migration_decision", F.lit("")) == "RETAIN")
    a = impacts.agg(
        F.count(F.lit(1)).alias("assets"), F.count_if(scoped).alias("in_scope"),
        F.count_if(scoped & ~retained).alias("scheduled"), F.count_if(retained).alias("no_action_required"),
        F.count_if(scoped & F.col("quantum_vulnerable")).alias("quantum_vulnerable"),
        F.count_if(scoped & (F.col("quantum_class") == kb.BROKEN)).alias("classically_broken"),
        *[F.count_if(scoped & (F.col("priority_band") == b)).alias(b.lower()) for b in pol.PRIORITY_BANDS])
    return a.crossJoin(items.agg(F.count_if(F.col("unblocks") > 0).alias("gating_assets")))


def roadmap_view(items: DataFrame, phase: str | None = None, band: str | None = None) -> DataFrame:
    """Listed items of a phase and/or band, with the truncation count of each phase."""
    known = [p[0] for p in pol.PHASES]
    if phase is not None and phase.upper() not in known:
        raise ValueError(f"no roadmap phase {phase!r}; available: {known}")
    sizes = items.groupBy("phase").agg(F.greatest(F.lit(0), F.count(F.lit(1)) - ITEMS_PER_PHASE).alias("items_truncated"))
    out = listed_items(items).join(F.broadcast(sizes), "phase")
    if phase is not None:
        out = out.where(F.lower("phase") == phase.lower())
    if band is not None:
        out = out.where(F.lower("band") == band.lower())
    return out

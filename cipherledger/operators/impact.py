"""Migration impact: reach, coupling, prerequisites, effort and roll-ups.

Prerequisites are kept as (asset, resource) x (resource, gating asset) and only counted,
since the pairs behind one popular library grow with the square of its users. Explicit
lists are available for requested assets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import case, present, spread_nulls
from ..session import drop_stage, write_stage
from .graph import (NODES3, RESOURCES, attach, issuer_edges, library_label, per_set_sizes,
                    protocol_key, resource_array, resource_columns, resource_sets, set_key,
                    with_peak_score)
from .risk import OLD_TLS

KINDS = ("application", "service", "repository", "container", "file", "owner",
         "business-unit", "business-function")
PLURAL = {"application": "applications", "service": "services", "repository": "repositories",
          "container": "containers", "file": "files", "owner": "owners",
          "business-unit": "business_units", "business-function": "business_functions"}


def with_places(assets: DataFrame) -> DataFrame:
    """Resource nodes and set key. A mapped asset without any unit of change gets its
    own place as a private one, so its reach is computed the same way."""
    a = resource_columns(assets)
    bare = F.col("certificate_node").isNull() & F.col("library_node").isNull() & F.col("protocol_node").isNull()
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    place = F.concat_ws("\u0002", F.lit("place:"), blank("file"), blank("container"), blank("application"))
    a = a.withColumn("coupled_set", ~bare)
    a = a.withColumn("certificate_node", F.when(bare & F.col("owner").isNotNull(), place).otherwise(F.col("certificate_node")))
    return a.withColumn("set_key", set_key())


def reach_members(assets: DataFrame, estate) -> DataFrame:
    """Distinct (resource, kind, unit): up from the asset over file, repository,
    container and application to the owner, then down to services and functions.

    Every step is a join on distinct pairs, so a resource used by a third of all assets
    carries its distinct files once and its distinct applications from there on.
    """
    mapped = assets.where("owner IS NOT NULL AND set_key IS NOT NULL")
    exploded = mapped.select(F.explode(resource_array()).alias("resource"), "file", "repository",
                             "container", "application")
    known = estate.applications.select("app_id")
    declared = lambda df, col: df.join(known, "app_id", "left_semi").select(col, "app_id")
    all_mapped = assets.where("owner IS NOT NULL")
    repo_apps = declared(estate.repositories, "repository").unionByName(
        all_mapped.where("repository <> ''").select("repository", F.col("application").alias("app_id"))).distinct()
    container_apps = declared(estate.containers, "container").unionByName(
        all_mapped.where("container <> ''").select("container", F.col("application").alias("app_id"))).distinct()
    parents = all_mapped.where("file <> ''").select(
        "file", F.col("repository").alias("up_repo"),
        F.when(F.col("repository").isNull(), F.col("application")).alias("up_app")).distinct()

    files = exploded.where("file <> ''").select("resource", "file").distinct()
    above = files.join(parents, "file").select("resource", "up_repo", "up_app").distinct()
    repos = above.where("up_repo IS NOT NULL").select("resource", F.col("up_repo").alias("repository")).distinct()
    conts = exploded.where("container <> ''").select("resource", "container").distinct()
    apps = reduce(DataFrame.unionByName, [
        repos.join(repo_apps, "repository").select("resource", "app_id"),
        above.where("up_app IS NOT NULL").select("resource", F.col("up_app").alias("app_id")),
        conts.join(container_apps, "container").select("resource", "app_id"),
        exploded.where("coalesce(file, '') = ''").select("resource", F.col("application").alias("app_id")),
    ]).distinct()
    about = apps.join(estate.applications.select("app_id", "owner", "business_unit", "business_function"), "app_id")

    def rows(df, kind, unit):
        return df.select("resource", F.lit(kind).alias("kind"), F.col(unit).alias("unit"))

    return reduce(DataFrame.unionByName, [
        rows(files, "file", "file"), rows(repos, "repository", "repository"),
        rows(conts, "container", "container"), rows(apps, "application", "app_id"),
        rows(about.where("owner <> 'unassigned'"), "owner", "owner").distinct(),
        rows(about.where("business_unit NOT IN ('', 'unassigned')"), "business-unit", "business_unit").distinct(),
        rows(about.where("business_function <> ''"), "business-function", "business_function").distinct(),
        rows(apps.join(estate.services, "app_id"), "service", "service").distinct()])


def with_gates(assets: DataFrame) -> DataFrame:
    """Which assets gate others on their library or protocol, and which wait."""
    c = F.col
    old_tls = (c("protocol") == "TLS") & c("protocol_version").isin(*OLD_TLS) & c("protocol_node").isNotNull()
    upgrade = c("recommended_strategy") == "upgrade-protocol"
    false = F.lit(False)
    return assets.withColumns({
        "is_provider": F.coalesce(c("library_node").isNotNull() & c("algorithm").isNull()
                                  & c("migration_decision").isin("UPGRADE", "HARDEN"), false),
        "is_gate": F.coalesce(old_tls & upgrade, false),
        "waits": F.coalesce(old_tls & ~upgrade, false)})


def certificate_holders(assets: DataFrame) -> DataFrame:
    """The first asset of each certificate answers for it."""
    return (assets.where("certificate_serial <> ''").groupBy(F.col("certificate_node").alias("dst"))
            .agg(F.min_by(F.struct("asset_id", "asset_name", "library_node", "protocol_node",
                                   "is_provider", "is_gate", "migration_months"), "asset_seq").alias("h")))


def pki_pairs(assets: DataFrame) -> DataFrame:
    """(asset, issuing asset): one row per asset and issuer, so linear in the assets.
    ``via_provider``/``via_protocol`` tell that another kind names the same pair."""
    links = issuer_edges(assets).withColumnRenamed("src", "certificate_node")
    a = assets.where("certificate_serial <> ''").select(
        "asset_id", "certificate_node", F.col("certificate_serial").alias("serial"), F.col("library_node").alias("a_lib"),
        F.col("protocol_node").alias("a_proto"), "waits")
    j = (a.join(links, "certificate_node").join(certificate_holders(assets), "dst")
         .where("asset_id <> h.asset_id"))
    same_lib = F.coalesce(F.col("h.is_provider") & (F.col("h.library_node") == F.col("a_lib")), F.lit(False))
    same_proto = F.coalesce(F.col("h.is_gate") & F.col("waits") & (F.col("h.protocol_node") == F.col("a_proto")), F.lit(False))
    return j.select("asset_id", "serial", F.col("h.asset_id").alias("prereq_id"), F.expr("substring(dst, 13)").alias("prereq_serial"),
                    F.col("h.asset_name").alias("prereq_name"),
                    F.col("h.migration_months").alias("prereq_months"),
                    same_lib.alias("via_provider"), same_proto.alias("via_protocol")).distinct()


def _per_set(a: DataFrame, sets: DataFrame) -> DataFrame:
    """Gate counts and months of each resource set's library and protocol."""
    months = F.col("migration_months")
    provider_months = F.when(F.col("is_provider"), months)
    # Distinct month values are a handful, whatever the number of assets.
    libs = a.where("library_node IS NOT NULL").groupBy("library_node").agg(
        F.count(F.lit(1)).alias("lib_users"), F.count_if("is_provider").alias("lib_providers"),
        F.max(months).alias("lib_months"),
        F.sort_array(F.collect_set(provider_months), asc=False).alias("gate_months"))
    top = (a.where("is_provider").groupBy("library_node", "migration_months").agg(F.count(F.lit(1)).alias("k"))
           .groupBy("library_node").agg(F.max_by("k", "migration_months").alias("at_top")))
    protos = a.where("protocol_node IS NOT NULL").groupBy("protocol_node").agg(
        F.count_if("waits").alias("proto_waiting"), F.count_if("is_gate").alias("proto_gates"),
        F.max(months).alias("proto_months"),
        F.max(F.when(F.col("is_gate"), months)).alias("proto_gate_months"))
    both = a.where("library_node IS NOT NULL AND protocol_node IS NOT NULL").groupBy(
        "library_node", "protocol_node").agg(
        F.count_if(F.col("is_provider") & F.col("is_gate")).alias("double_gates"),
        F.count_if("waits").alias("both_waiting"))
    certs = a.where("certificate_serial <> ''").groupBy("certificate_node").agg(F.max(months).alias("cert_months"))
    base = sets.select("set_key", *NODES3, "set_assets")
    key = F.col("set_key")

    def left(df, right, *names):
        on = [spread_nulls(F.col(n), key) == F.col("r_" + n) for n in names]
        r = right.select(*[F.col(n).alias("r_" + n) for n in names],
                         *[c for c in right.columns if c not in names])
        return df.join(r, on, "left").drop(*["r_" + n for n in names])

    out = left(base, libs.join(top, "library_node", "left"), "library_node")
    out = left(out, protos, "protocol_node")
    out = left(out, certs, "certificate_node")
    return left(out, both, "library_node", "protocol_node")


#: What the tables of a resource set and of prerequisites read of assets.
GATED = ("asset_id", "asset_name", "asset_seq", *NODES3, "set_key", "coupled_set", "owner", "application", "file", "repository",
         "container", "certificate_serial", "certificate_subject", "certificate_issuer", "migration_months",
         "is_provider", "is_gate", "waits")


def build_impacts(assets: DataFrame | list[DataFrame], estate, gated: DataFrame | None = None) -> DataFrame:
    """One row per asset. ``assets``, one table or parts that are joined on a column of
    theirs, must carry decisions; centrality columns pass through. Adds counts of reach,
    coupling and prerequisites, effort and blast radius. ``gated`` are the same assets with
    their gates, if these are stored already."""
    parts = [with_gates(with_places(p)) for p in (assets if isinstance(assets, list) else [assets])]
    a = gated.select(*GATED) if gated is not None else write_stage(reduce(DataFrame.unionByName, [p.select(*GATED) for p in parts]), "gated")
    per_set, pki = impact_tables(a, estate)
    drop_stage(a)
    out = write_stage(reduce(DataFrame.unionByName, [with_impact(p, per_set, pki) for p in parts]), "impacts")
    drop_stage(*per_set.values(), pki)
    return with_peak_score(out, "blast_radius", "blast_radius_score")


def impact_tables(a: DataFrame, estate) -> tuple[dict[str, DataFrame], DataFrame]:
    """Numbers of each resource set, by the column that assets on it are dealt by, and of
    the prerequisites among issuers. Sets of a place lie with its file, those of a
    certificate with its serial; the others are few, and stored apart their size is known."""
    sets = write_stage(resource_sets(a), "impact-sets")
    members = write_stage(reach_members(a, estate), "reach")
    sizes = write_stage(per_set_sizes(sets, members, PLURAL).withColumnRenamed("certificate_node", "set_certificate"), "impact-sizes")
    first_app = (sets.select("set_key", F.explode(resource_array()).alias("resource"))
                 .join(members.where("kind = 'application'"), "resource")
                 .groupBy("set_key").agg(F.min("unit").alias("first_application")))
    per_set = write_stage(_per_set(a, sets).drop(*NODES3, "set_assets").join(sizes, "set_key")
                          .join(first_app, "set_key", "left"), "impact-per-set")
    pairs = write_stage(pki_pairs(a), "pki-pairs")
    other = ~F.col("via_provider") & ~F.col("via_protocol")
    waiting = pairs.groupBy("asset_id", "serial").agg(
        F.count_if(~F.col("via_provider")).alias("pki_prereqs"),
        F.count_if(F.col("via_protocol") & ~F.col("via_provider")).alias("pki_protocol"),
        F.max("prereq_months").alias("pki_months"), F.lit(None).cast("bigint").alias("pki_unblocks"))
    gating = pairs.groupBy(F.col("prereq_id").alias("asset_id"), F.col("prereq_serial").alias("serial")).agg(
        F.lit(None).cast("bigint").alias("pki_prereqs"), F.lit(None).cast("bigint").alias("pki_protocol"),
        F.lit(None).cast("int").alias("pki_months"), F.count_if(other).alias("pki_unblocks"))
    pki = write_stage(waiting.unionByName(gating).groupBy("asset_id", "serial").agg(
        *[F.max(c).alias(c) for c in ("pki_prereqs", "pki_protocol", "pki_months", "pki_unblocks")]), "pki")
    node = F.col("set_certificate")
    file = F.when(node.startswith("place:"), F.get(F.split(node, "\u0002"), F.lit(1)))
    serial = F.when(node.startswith("certificate:"), F.expr("substring(set_certificate, 13)"))
    keyed = per_set.withColumns({"by_file": F.when(present(file), file), "by_dealt": serial}).drop("set_certificate")
    tables = {u: write_stage(keyed.where(F.col(u).isNotNull()).drop(*{"by_file", "by_dealt"} - {u}).withColumnsRenamed({u: "unit", "set_key": "n_key"}), "impact-" + u)
              for u in ("by_file", "by_dealt")}
    tables["joint"] = write_stage(keyed.where("by_file IS NULL AND by_dealt IS NULL").drop("by_file", "by_dealt"), "impact-joint")
    drop_stage(sets, members, sizes, pairs, per_set)
    return tables, pki


def _attached(part: DataFrame, per_set: dict[str, DataFrame], pki: DataFrame) -> DataFrame:
    """Both tables joined to assets, on the column that these are dealt by where they are."""
    joint = per_set["joint"]
    values = [c for c in joint.columns if c != "set_key"]
    by = [u for u in ("by_file", "by_dealt") if u in part.columns]
    if not by:
        every = reduce(DataFrame.unionByName, [joint, *[per_set[u].withColumnRenamed("n_key", "set_key").drop("unit") for u in ("by_file", "by_dealt")]])
        return attach(part, every).join(pki.drop("serial"), "asset_id", "left")
    near = per_set[by[0]].select("unit", "n_key", *[F.col(v).alias("n_" + v) for v in values], F.lit(True).alias("n_found"))
    j = part.join(near, (F.col(by[0]) == F.col("unit")) & (F.col("set_key") == F.col("n_key")), "left")
    j = attach(j, joint)
    j = j.withColumns({v: F.when(F.col("n_found"), F.col("n_" + v)).otherwise(F.col(v)) for v in values})
    j = j.drop("unit", "n_key", "n_found", *["n_" + v for v in values])
    if by[0] == "by_dealt":
        found = pki.withColumnsRenamed({"asset_id": "w_id", "serial": "w_serial"})
        j = j.join(found, (F.col("by_dealt") == F.col("w_serial")) & (F.col("asset_id") == F.col("w_id")), "left").drop("w_id", "w_serial")
    else:   # only assets of certificates wait for issuers or are issuers
        j = j.withColumns({c: F.lit(None).cast("bigint") for c in pki.columns if c.startswith("pki_")})
    return j.drop(by[0])


def with_impact(part: DataFrame, per_set: DataFrame, pki: DataFrame) -> DataFrame:
    """Assets with their reach, coupling, prerequisites, effort and blast radius."""
    j = _attached(part, per_set, pki)
    c, zero = F.col, F.lit(0)
    n = lambda name: F.coalesce(c(name), zero)
    as_int = lambda cond: F.when(cond, 1).otherwise(0)
    provider_prereqs = n("lib_providers") - as_int(c("is_provider"))
    protocol_prereqs = F.when(c("waits"), n("proto_gates") - n("double_gates") - n("pki_protocol")).otherwise(0)
    unblocks = (F.when(c("is_provider"), n("lib_users") - 1).otherwise(0)
                + F.when(c("is_gate"), n("proto_waiting") - F.when(c("is_provider"), n("both_waiting")).otherwise(0)).otherwise(0)
                + n("pki_unblocks"))
    top = F.try_element_at("gate_months", F.lit(1))
    alone_at_top = c("is_provider") & (c("migration_months") == top) & (c("at_top") == 1)
    provider_months = F.when(alone_at_top, F.try_element_at("gate_months", F.lit(2))).otherwise(top)
    prereq_months = F.greatest(zero, F.coalesce(provider_months, zero),
                               F.when(c("waits"), n("proto_gate_months")).otherwise(0), n("pki_months"))
    coupled_months = F.greatest("migration_months", *[
        F.coalesce(m, c("migration_months")) for m in ("lib_months", "proto_months", "cert_months")])
    out = j.withColumns({
        **{PLURAL[k]: n(PLURAL[k]).cast("bigint") for k in KINDS},
        "dependent_assets": F.when(c("coupled_set"), n("group_size") - 1).otherwise(0).cast("bigint"),
        "provider_prerequisites": provider_prereqs.cast("bigint"),
        "pki_prerequisites": n("pki_prereqs").cast("bigint"),
        "protocol_prerequisites": protocol_prereqs.cast("bigint"),
        "unblocks": unblocks.cast("bigint"),
        "prerequisite_months": prereq_months.cast("int"),
        "coupled_months": coupled_months.cast("int"),
        "certificates": as_int(c("certificate_serial") != "").cast("bigint"),
        "change_units": F.array_compact(F.array(F.when(c("certificate_serial") != "", F.coalesce("certificate_subject", "certificate_serial")),
                                                library_label(), protocol_key())),
    }).withColumns({
        "prerequisites": c("provider_prerequisites") + c("pki_prerequisites") + c("protocol_prerequisites"),
        "coordinated_effort_months": (c("coupled_months") + c("prerequisite_months")).cast("int"),
        "blast_radius": c("applications") + c("services") + c("repositories") + c("containers") + c("certificates")})
    drop = [x for x in per_set["joint"].columns if x not in ("set_key", "first_application", *PLURAL.values())]
    return out.drop(*drop, "pki_prereqs", "pki_protocol", "pki_months", "pki_unblocks")


# --- explicit prerequisites for requested assets ---------------------------------------
def prerequisite_pairs(assets: DataFrame, asset_ids: list[str] | None = None) -> DataFrame:
    """(asset_id, prereq_id, prereq_name, kind): first kind wins per pair. With ids the
    output is as large as their answer; without, it is quadratic in a popular resource."""
    a = with_gates(with_places(assets))
    focus = a.where(F.col("asset_id").isin(asset_ids)) if asset_ids is not None else a

    def gate(node, flag, extra=None):
        g = a.where(flag).select(node, F.col("asset_id").alias("prereq_id"), F.col("asset_name").alias("prereq_name"))
        f = focus if extra is None else focus.where(extra)
        return f.select("asset_id", node).join(g, node).where("asset_id <> prereq_id").drop(node)

    pki = pki_pairs(a).select("asset_id", "prereq_id", "prereq_name")
    if asset_ids is not None:
        pki = pki.where(F.col("asset_id").isin(asset_ids))
    kinds = [("provider", gate("library_node", "is_provider"), 0), ("pki", pki, 1),
             ("protocol", gate("protocol_node", "is_gate", "waits"), 2)]
    rows = reduce(DataFrame.unionByName, [
        df.withColumn("k", F.struct(F.lit(r).alias("rank"), F.lit(k).alias("kind"))) for k, df, r in kinds])
    return (rows.groupBy("asset_id", "prereq_id")
            .agg(F.min("k").alias("k"), F.first("prereq_name").alias("prereq_name"))
            .select("asset_id", "prereq_id", "prereq_name", F.col("k.kind").alias("kind")))


def critical_paths(pairs: DataFrame, focus: DataFrame) -> DataFrame:
    """Longest prerequisite chain ending at each focus asset, in execution order, along
    explicit pairs; ``chains`` has lengths over all kinds without pairs or paths.

    One frontier join per step with the path carried as an array; a node already on the
    path is not entered again, so cycles end. Ties go to the smallest path.
    """
    step = write_stage(pairs.select(F.col("asset_id").alias("at"), F.col("prereq_id").alias("nxt")).distinct(), "chain-steps")
    paths = focus.select("asset_id", F.col("asset_id").alias("head"), F.array("asset_id").alias("path"))
    best = paths
    while True:
        paths = (paths.join(step, F.col("head") == F.col("at"))
                 .where(~F.array_contains("path", F.col("nxt")))
                 .select("asset_id", F.col("nxt").alias("head"),
                         F.concat(F.array("nxt"), "path").alias("path")))
        paths = write_stage(paths, "chain")
        if paths.isEmpty():
            break
        best = best.unionByName(paths)
    return (best.groupBy("asset_id").agg(F.min_by("path", F.struct(
        (-F.size("path")).alias("n"), F.array_join("path", ">").alias("p"))).alias("path"))
        .withColumn("length", F.size("path")))


# --- roll-ups --------------------------------------------------------------------------
def change_units(impacts: DataFrame, estate, limit: int | None = 20) -> DataFrame:
    """One row per unit of change: assets, and the distinct applications, services and
    owners its assets reach (through any of their units)."""
    nodes = [n for n in NODES3]
    sets = impacts.where("set_key IS NOT NULL AND coupled_set").groupBy("set_key").agg(
        *[F.first(n).alias(n) for n in nodes], F.count(F.lit(1)).alias("k"),
        F.max("blast_radius").alias("blast"))
    names = (impacts.where("certificate_serial <> ''").groupBy(F.col("certificate_node").alias("node"))
             .agg(F.min_by(F.coalesce("certificate_subject", "certificate_serial"), "asset_seq").alias("c_label")))
    units = (sets.select("set_key", "k", "blast", F.explode(resource_array()).alias("node"))
             .join(names, "node", "left")
             .withColumn("unit", F.coalesce("c_label", F.when(F.col("node").startswith("library:"), F.regexp_replace(
                 F.expr("substring(node, 9)"), "@", " ")).otherwise(F.regexp_replace("node", "^protocol:", "")))))
    units = write_stage(units.select("set_key", "k", "blast", "unit"), "units")
    sized = units.groupBy("unit").agg(F.sum("k").alias("assets"), F.max("blast").alias("max_blast_radius"))
    resources = sets.select("set_key", F.explode(resource_array()).alias("resource"))
    members = reach_members(impacts, estate).where(F.col("kind").isin("application", "service", "owner"))
    reached = (units.select("set_key", F.col("unit").alias("label")).distinct().join(resources, "set_key")
               .select("label", "resource").distinct().join(members, "resource")
               .select("label", "kind", "unit").distinct())
    counts = reached.groupBy(F.col("label").alias("unit")).agg(*[
        F.count_if(F.col("kind") == k).alias(PLURAL[k]) for k in ("application", "service", "owner")])
    out = sized.join(counts, "unit", "left").fillna(0).select(
        "unit", "assets", "applications", "services", "owners", "max_blast_radius")
    out = out.orderBy(F.desc("assets"), "unit")
    return out.limit(limit) if limit else out


def gating_assets(impacts: DataFrame, limit: int = 15) -> DataFrame:
    return (impacts.where("unblocks > 0").select(
        "asset_id", "asset_name", "migration_decision", "unblocks", "applications")
        .orderBy(F.desc("unblocks"), "asset_id").limit(limit))


def widest(impacts: DataFrame, limit: int = 15) -> DataFrame:
    return (impacts.select("asset_id", "asset_name", "migration_decision", "blast_radius", "blast_radius_score")
            .orderBy(F.desc("blast_radius"), "asset_id").limit(limit))


def owner_rollup(impacts: DataFrame, estate) -> DataFrame:
    """Per accountable owner: assets whose reach includes it, their applications and the
    longest coordinated duration."""
    sets = impacts.where("set_key IS NOT NULL").groupBy("set_key").agg(
        *[F.first(n).alias(n) for n in NODES3], F.count(F.lit(1)).alias("k"),
        F.max("coordinated_effort_months").alias("months"))
    resources = write_stage(sets.select("set_key", "k", "months", F.explode(resource_array()).alias("resource")), "owner-sets")
    members = write_stage(reach_members(impacts, estate).where("kind IN ('owner', 'application')"), "owner-reach")
    owners = (resources.join(members.where("kind = 'owner'"), "resource")
              .select("set_key", "k", "months", F.col("unit").alias("owner")).distinct())
    apps = (owners.select("owner", "set_key").join(resources.select("set_key", "resource"), "set_key")
            .select("owner", "resource").distinct()
            .join(members.where("kind = 'application'"), "resource").select("owner", "unit").distinct()
            .groupBy("owner").agg(F.count(F.lit(1)).alias("applications")))
    return (owners.groupBy("owner").agg(F.sum("k").alias("assets"), F.max("months").alias("longest_coordinated_months"))
            .join(apps, "owner", "left").select("owner", "assets", "applications", "longest_coordinated_months"))

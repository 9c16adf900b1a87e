"""Asset graph: nodes, edges, neighbourhoods and dependency centrality.

Shared resources (a library build, a protocol version, a certificate) are units of
change. A resource with k users implies k*k coupled pairs, so nothing here lists pairs:
everything is aggregated per resource and combined per *resource set* (an asset has at
most one library, one protocol and one certificate), by inclusion and exclusion.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import present, round_tenth, spread_nulls
from ..session import drop_stage, write_stage

RESOURCES = ("certificate", "library", "protocol")   # finest first


def library_key() -> Column:
    return F.when(present(F.col("library")), F.concat_ws(
        "@", "library", F.when(present(F.col("library_version")), F.col("library_version"))))


def library_label() -> Column:
    return F.when(present(F.col("library")), F.concat_ws(
        " ", "library", F.when(present(F.col("library_version")), F.col("library_version"))))


def protocol_key() -> Column:
    version = F.when(present(F.col("protocol_version")), F.col("protocol_version")).otherwise("unspecified")
    return F.when(present(F.col("protocol")), F.concat_ws("/", "protocol", version))


def resource_columns(assets: DataFrame) -> DataFrame:
    """Node ids of the units of change each asset uses."""
    serial = F.when(present(F.col("certificate_serial")), F.col("certificate_serial"))
    return assets.withColumns({
        "library_node": F.concat(F.lit("library:"), library_key()),
        "protocol_node": F.concat(F.lit("protocol:"), protocol_key()),
        "certificate_node": F.concat(F.lit("certificate:"), serial),
        "algorithm_node": F.concat(F.lit("algorithm:"), F.when(present(F.col("algorithm")), F.col("algorithm")))})


def resource_array() -> Column:
    return F.array_compact(F.array("certificate_node", "library_node", "protocol_node"))


# --- nodes and edges ------------------------------------------------------------------
NODE_ATTRS = ("application", "business_unit", "role", "asset_type", "confidence",
              "language", "version", "context_source")


def _node(df: DataFrame, kind: str, key, label, seq, **attrs) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    label = F.col(label) if isinstance(label, str) else label
    fields = [attrs.get(a, F.lit(None)).cast("string").alias(a) for a in NODE_ATTRS]
    return (df.where(present(key)).select(
        F.concat(F.lit(kind + ":"), key).alias("id"), F.lit(kind).alias("type"),
        label.alias("label"), seq.alias("seq"), *fields))


def asset_node(assets: DataFrame) -> DataFrame:
    c = F.col
    return _node(assets, "crypto-asset", "asset_id", "asset_name", F.concat(F.lit("1"), c("gkey")), application=c("application"), role=c("cryptographic_role"),
                 asset_type=c("asset_type"), confidence=c("confidence"))


def nodes(assets: DataFrame, estate) -> DataFrame:
    """One row per node: the first label is kept, a later non-null attribute wins."""
    apps = estate.applications
    c = F.col
    decl, seen = F.lit("0"), F.concat(F.lit("1"), c("gkey"))
    mapped = assets.where("owner IS NOT NULL")
    parts = [
        _node(apps, "application", "app_id", "name", decl, business_unit=c("business_unit"), context_source=c("context_source")),
        _node(apps.where("owner <> 'unassigned'"), "owner", "owner", "owner", c("app_id"), business_unit=c("business_unit")),
        _node(apps, "data", "app_id", F.concat("data_classification", F.lit(" / "), c("data_lifetime_years").cast("string"), F.lit("y")), decl),
        _node(apps.where("business_function <> ''"), "business-function", "app_id", "business_function", decl),
        _node(estate.services, "service", "service", "service", c("app_id"), application=c("app_id")),
        _node(estate.repositories, "repository", "repository", "repository", F.concat(F.lit("0"), c("app_id")), application=c("app_id")),
        _node(estate.containers, "container", "container", "container", F.concat(F.lit("0"), c("app_id")), application=c("app_id")),
        _node(mapped, "repository", "repository", "repository", seen, application=c("application")),
        _node(mapped, "file", "file", "file", seen, application=c("application"), language=c("language")),
        _node(mapped, "container", "container", "container", seen, application=c("application")),
        asset_node(assets),
        _node(assets, "algorithm", "algorithm", F.coalesce("algorithm_label", "algorithm"), seen),
        _node(assets, "library", library_key(), library_label(), seen, version=c("library_version")),
        _node(assets, "protocol", protocol_key(), protocol_key(), seen, version=c("protocol_version")),
        _node(assets, "certificate", "certificate_serial", F.coalesce("certificate_subject", "certificate_serial"), seen),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(
        F.min("type").alias("type"), F.min_by("label", "seq").alias("label"),
        *[F.max_by(F.col(a), F.when(F.col(a).isNotNull(), F.col("seq"))).alias(a) for a in NODE_ATTRS])


def issuer_edges(assets: DataFrame) -> DataFrame:
    """certificate -> issuing certificate; the last asset with a subject answers for it."""
    certs = assets.where("certificate_serial <> ''")
    by_subject = (certs.where("certificate_subject <> ''")
                  .groupBy(F.col("certificate_subject").alias("dn"))
                  .agg(F.max_by("certificate_serial", "asset_seq").alias("issuer_serial")))
    children = certs.where("certificate_issuer <> ''").select(
        "certificate_serial", F.col("certificate_issuer").alias("dn")).distinct()
    return (children.join(by_subject, "dn").where("certificate_serial <> issuer_serial")
            .select(F.concat(F.lit("certificate:"), "certificate_serial").alias("src"),
                    F.concat(F.lit("certificate:"), "issuer_serial").alias("dst")).distinct())


def edges(assets: DataFrame, estate) -> DataFrame:
    """Distinct typed edges. Endpoints come from the same rows that make the nodes, and
    owner or function edges are only built where the node is, so none can dangle."""
    apps, c = estate.applications, F.col
    nid = lambda kind, col: F.concat(F.lit(kind + ":"), F.col(col))
    known_apps = apps.select(F.col("app_id").alias("k_app"))

    def edge(df, kind, src, dst):
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"))

    mapped = assets.where("owner IS NOT NULL")
    r = resource_columns(assets)
    anode = nid("crypto-asset", "asset_id")
    has_file = mapped.where("file <> ''")
    declared = lambda df, col: df.join(known_apps, df.app_id == F.col("k_app"), "left_semi").where(present(c(col)))
    parts = [
        edge(apps.where("owner <> 'unassigned'"), "accountable-for", nid("owner", "owner"), nid("application", "app_id")),
        edge(apps, "protects", nid("application", "app_id"), nid("data", "app_id")),
        edge(apps.where("business_function <> ''"), "serves", nid("application", "app_id"), nid("business-function", "app_id")),
        edge(declared(estate.services, "service"), "runs", nid("application", "app_id"), nid("service", "service")),
        edge(declared(estate.repositories, "repository"), "owns", nid("application", "app_id"), nid("repository", "repository")),
        edge(declared(estate.containers, "container"), "deploys", nid("application", "app_id"), nid("container", "container")),
        edge(mapped.where("repository <> ''"), "owns", nid("application", "application"), nid("repository", "repository")),
        edge(has_file, "contains", F.coalesce(nid("repository", "repository"), nid("application", "application")), nid("file", "file")),
        edge(has_file, "declares", nid("file", "file"), anode),
        edge(mapped.where("coalesce(file, '') = ''"), "declares", nid("application", "application"), anode),
        edge(mapped.where("container <> ''"), "deploys", nid("application", "application"), nid("container", "container")),
        edge(mapped.where("container <> ''"), "declares", nid("container", "container"), anode),
        edge(r.where("algorithm_node IS NOT NULL"), "uses-algorithm", anode, c("algorithm_node")),
        edge(r.where("library_node IS NOT NULL"), "provided-by", anode, c("library_node")),
        edge(r.where("protocol_node IS NOT NULL"), "negotiates", anode, c("protocol_node")),
        edge(r.where("certificate_node IS NOT NULL"), "bound-to", anode, c("certificate_node")),
        issuer_edges(assets).withColumn("type", F.lit("issued-by")),
    ]
    return reduce(DataFrame.unionByName, parts).where("src <> dst").distinct()


def graph_counts(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    n = node_rows.groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("node"))
    e = edge_rows.groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("edge"))
    return n.unionByName(e).select("kind", "type", "n")


def counted_parts(parts: list[DataFrame], estate) -> DataFrame:
    """``graph_counts`` without nodes and edges being listed: an asset lists its own, and
    those that end at it are told apart where it lies, as its id has its file and serial;
    only the others, which assets share, meet by name."""
    empty = parts[0].limit(0)
    nid = lambda kind, col: F.concat(F.lit(kind + ":"), F.col(col) if isinstance(col, str) else col)
    c, no = F.col, F.lit(None).cast("string")

    def item(cond, kind, type_, src, dst=no, own=False):
        return F.when(cond, F.struct(F.lit(own).alias("own"), F.lit(kind).alias("kind"), F.lit(type_).alias("type"),
                                     src.alias("src"), dst.alias("dst")))

    mapped, has = c("owner").isNotNull(), lambda col: present(c(col))
    anode, app, file = nid("crypto-asset", "asset_id"), nid("application", "application"), nid("file", "file")
    repo, cont = nid("repository", "repository"), nid("container", "container")
    using = {"algorithm": "uses-algorithm", "library": "provided-by", "protocol": "negotiates", "certificate": "bound-to"}
    items = [
        item(mapped & has("repository"), "node", "repository", repo), item(mapped & has("file"), "node", "file", file),
        item(mapped & has("container"), "node", "container", cont), item(has("asset_id"), "node", "crypto-asset", anode, own=True),
        *[item(c(k + "_node").isNotNull(), "node", k, c(k + "_node")) for k in using],
        item(mapped & has("repository"), "edge", "owns", app, repo),
        item(mapped & has("file"), "edge", "contains", F.coalesce(repo, app), file),
        item(mapped & has("file"), "edge", "declares", file, anode, True),
        item(mapped & ~F.coalesce(has("file"), F.lit(False)), "edge", "declares", app, anode, True),
        item(mapped & has("container"), "edge", "deploys", app, cont),
        item(mapped & has("container"), "edge", "declares", cont, anode, True),
        *[item(c(k + "_node").isNotNull(), "edge", kind, anode, c(k + "_node"), True) for k, kind in using.items()]]
    rows = []
    for p in parts:
        unit = [x for x in p.columns if x.startswith("by_")]
        listed = resource_columns(p).select(*unit, F.explode(F.array_compact(F.array(*items))).alias("i")).select(*unit, "i.*")
        if unit:   # a shared name of a certificate lies with its serial
            rows.append(listed.distinct().drop(*unit))
        else:
            rows.append(listed.distinct())
    declared = nodes(empty, estate).select(F.lit(False).alias("own"), F.lit("node").alias("kind"), "type", c("id").alias("src"), no.alias("dst"))
    known = edges(empty, estate).select(F.lit(False).alias("own"), F.lit("edge").alias("kind"), "type", "src", "dst")
    shared = lambda col: F.when(~c("own"), c(col)).alias(col)
    told = reduce(DataFrame.unionByName, [*rows, declared, known]).groupBy("own", "kind", "type", shared("src"), shared("dst")).agg(
        F.count(F.lit(1)).alias("k"))
    n = told.groupBy("kind", "type").agg(F.sum(F.when(c("own"), c("k")).otherwise(1)).alias("n"))
    # the last part has the certificates
    issued = issuer_edges(normalized_certificates(parts[-1])).agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(issued.where("n > 0").select(F.lit("edge").alias("kind"), F.lit("issued-by").alias("type"), "n"))


def normalized_certificates(assets: DataFrame) -> DataFrame:
    """What issuer edges read, stored once."""
    return write_stage(assets.where("certificate_serial <> ''").select(
        "certificate_serial", "certificate_subject", "certificate_issuer", "asset_seq"), "certificates")


def reachable(edge_rows: DataFrame, seeds: DataFrame, depth: int, direction: str = "both",
              node_rows: DataFrame | None = None, types: tuple | None = None) -> DataFrame:
    """(seed, id, hops) within ``depth`` hops, breadth first.

    Each round joins the frontier once with the edges and drops what was seen. Rounds are
    written as stage tables: the plan stays short and a lost executor costs one round.
    A node-type filter narrows the output only, not the walk.
    """
    if direction not in ("in", "out", "both"):
        raise ValueError(f"unknown direction {direction!r}")
    out = edge_rows.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    back = edge_rows.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    hop = {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()
    if depth > 1:
        hop = write_stage(hop, "adjacency")
    seen = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hops")).distinct()
    frontier = seen
    for i in range(1, depth + 1):
        step = (frontier.join(hop, frontier.id == hop.a)
                .select("seed", F.col("b").alias("id")).distinct()
                .join(seen.select("seed", "id"), ["seed", "id"], "left_anti")
                .withColumn("hops", F.lit(i)))
        frontier = write_stage(step, f"frontier-{i}") if i < depth else step
        seen = seen.unionByName(frontier)
    found = seen.where("hops > 0")
    if types:
        kinds = node_rows.where(F.col("type").isin(*types)).select("id")
        found = found.join(kinds, "id", "left_semi")
    return found


def neighbourhood(node_rows: DataFrame, edge_rows: DataFrame, asset_id: str,
                  depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Induced subgraph around one asset."""
    start = f"crypto-asset:{asset_id}"
    seed = node_rows.where(F.col("id") == start).select("id")
    ids = reachable(edge_rows, seed, depth).select("id").unionByName(seed).distinct()
    inside = edge_rows.join(ids, edge_rows.src == ids.id, "left_semi").join(
        ids, edge_rows.dst == ids.id, "left_semi")
    return node_rows.join(ids, "id", "left_semi"), inside


# --- walks in which assets are not listed -------------------------------------------------
def place_links() -> Column:
    """(type, src, dst) of the edges between the places of a mapped asset."""
    nid = lambda kind: F.concat(F.lit(kind + ":"), F.col(kind))
    link = lambda has, kind, src, dst: F.when(present(F.col(has)), F.struct(F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst")))
    app, repo = nid("application"), nid("repository")
    return F.array_compact(F.array(link("repository", "owns", app, repo), link("container", "deploys", app, nid("container")),
                                   link("file", "contains", F.coalesce(repo, app), nid("file"))))


def declaring() -> Column:
    """Nodes that declare a mapped asset: its file, or else its application, and its container."""
    nid = lambda kind: F.concat(F.lit(kind + ":"), F.col(kind))
    return F.array_compact(F.array(F.when(present(F.col("file")), nid("file")).otherwise(nid("application")),
                                   F.when(present(F.col("container")), nid("container"))))


USES = {"algorithm_node": "uses-algorithm", "library_node": "provided-by", "protocol_node": "negotiates", "certificate_node": "bound-to"}


def contacts(parts: list[DataFrame]) -> DataFrame:
    """Mapped assets, counted where they lie: one row (k, spots, n, uses) for those of one
    file or certificate that lie in the same places. ``uses`` are the resources of any."""
    rows = []
    spot = F.when(F.col("owner").isNotNull(), F.struct("application", "repository", "file", "container"))
    for p in parts:
        unit = [c for c in p.columns if c.startswith("by_")]
        flat = lambda name: F.array_distinct(F.flatten(F.collect_set(name)))
        own = resource_columns(p).withColumns({"spot": spot, "used": F.array_compact(F.array(*USES))}).groupBy(*unit, "asset_id").agg(
            F.array_sort(F.collect_set("spot")).alias("spots"), flat("used").alias("used"))
        rows.append(own.where(F.size("spots") > 0).groupBy(*unit, "spots").agg(F.count(F.lit(1)).alias("n"), flat("used").alias("uses")).drop(*unit))
    return write_stage(reduce(DataFrame.unionByName, rows).withColumn("k", F.monotonically_increasing_id()), "contacts")


def reach_counts(parts: list[DataFrame], estate, kind: str, depth: int) -> DataFrame:
    """(seed, hops, n): how many nodes ``reachable`` finds along the edges from each node of
    a declared kind, without assets being listed. Edges lead from places to assets, on to
    what these use, and among certificates, never back, so each is walked in its turn."""
    c, empty = F.col, parts[0].limit(0)
    known = contacts(parts)
    spots = known.select("k", F.explode("spots").alias("s")).select("k", "s.*")
    outer = edges(empty, estate).select("src", "dst").unionByName(
        spots.select(F.explode(place_links()).alias("e")).select("e.src", "e.dst")).where("src <> dst")
    seeds = nodes(empty, estate).where(c("type") == kind).select("id")
    seen = write_stage(seeds.select(c("id").alias("seed"), "id", F.lit(0).alias("hops")).unionByName(
        reachable(outer, seeds, depth, "out")), "places-reached")
    near = (spots.select("k", F.explode(declaring()).alias("id")).join(seen, "id").groupBy("seed", "k")
            .agg((F.min("hops") + 1).alias("hops")).where(c("hops") <= depth))
    held = write_stage(near.join(known.drop("spots"), "k").drop("k"), "assets-reached")
    used = (held.where(c("hops") < depth).select("seed", F.explode("uses").alias("id"), (c("hops") + 1).alias("hops"))
            .groupBy("seed", "id").agg(F.min("hops").alias("hops")))
    used = write_stage(used, "resources-reached")
    certified = lambda: used.where(c("id").startswith("certificate:") & (c("hops") < depth))
    if not certified().isEmpty():
        issued = write_stage(issuer_edges(normalized_certificates(parts[-1])), "issued")
        for i in range(1, depth):
            step = certified().where(c("hops") == i).join(issued, c("id") == c("src")).select("seed", c("dst").alias("id"), F.lit(i + 1).alias("hops"))
            used = write_stage(used.unionByName(step).groupBy("seed", "id").agg(F.min("hops").alias("hops")), "resources-reached")
    one = F.lit(1).cast("bigint").alias("n")
    found = seen.where("hops > 0").select("seed", "hops", one).unionByName(held.select("seed", "hops", "n")).unionByName(used.select("seed", "hops", one))
    return found.groupBy("seed", "hops").agg(F.sum("n").alias("n"))


def asset_lines(parts: list[DataFrame]) -> DataFrame:
    """What edges read of assets, stored as narrow rows. Places of unmapped assets are null;
    ``twin`` marks rows that share their id, which lie in one file or certificate."""
    mapped = lambda name: F.when(F.col("owner").isNotNull(), F.col(name)).alias(name)
    certified = lambda name: F.when(F.col("certificate_serial") != "", F.col(name)).alias(name)
    unit = lambda p: [x for x in p.columns if x.startswith("by_")]
    return write_stage(reduce(DataFrame.unionByName, [p.select(
        "asset_id", (F.count(F.lit(1)).over(Window.partitionBy(*unit(p), "asset_id")) > 1).alias("twin"), *[mapped(n) for n in ("application", "repository", "file", "container")],
        "algorithm", "library", "library_version", "protocol", "protocol_version", "certificate_serial",
        *[certified(n) for n in ("certificate_subject", "certificate_issuer", "asset_seq")]) for p in parts]), "asset-lines")


def node_lines(parts: list[DataFrame]) -> DataFrame:
    """What nodes read of assets, stored as narrow rows; ``twin`` as in ``asset_lines``."""
    fields = ("asset_id", "asset_name", "gkey", "owner", "application", "repository", "file", "language", "container", "cryptographic_role",
              "asset_type", "confidence", "algorithm", "algorithm_label", "library", "library_version", "protocol", "protocol_version",
              "certificate_serial", "certificate_subject")
    unit = lambda p: [x for x in p.columns if x.startswith("by_")]
    return write_stage(reduce(DataFrame.unionByName, [p.select(*fields, (F.count(F.lit(1)).over(
        Window.partitionBy(*unit(p), "asset_id")) > 1).alias("twin")) for p in parts]), "node-lines")


def listed_nodes(lines: DataFrame, estate) -> DataFrame:
    """``nodes`` of stored rows: the node of an asset that shares its id with none is a row
    as it stands; the others meet by name."""
    alone = F.col("twin") == F.lit(False)
    own = asset_node(lines.where(alone)).drop("seq")
    return own.unionByName(nodes(lines.withColumn("asset_id", F.when(~alone, F.col("asset_id"))), estate))


def listed_edges(lines: DataFrame, estate) -> DataFrame:
    """``edges`` of stored rows: those of an asset that shares its id with none are listed
    as they stand; the others meet by name."""
    c = F.col
    shared = shared_edges(lines, estate)
    own = resource_columns(lines).select("twin", F.explode(asset_links()).alias("e")).select("twin", "e.src", "e.dst", "e.type").where("src <> dst")
    return shared.unionByName(own.where(~c("twin")).drop("twin")).unionByName(own.where("twin").drop("twin").distinct())


def shared_edges(lines: DataFrame, estate) -> DataFrame:
    """Distinct edges that do not end at an asset."""
    return edges(lines.limit(0).withColumn("owner", F.lit(None).cast("string")), estate).unionByName(
        lines.select(F.explode(place_links()).alias("e")).select("e.src", "e.dst", "e.type")).unionByName(
        issuer_edges(lines).withColumn("type", F.lit("issued-by"))).where("src <> dst").distinct()


def asset_links() -> Column:
    """(type, src, dst, end) of an asset's own edges; ``end`` is the node that is no asset."""
    anode = F.concat(F.lit("crypto-asset:"), "asset_id")
    into = F.transform(declaring(), lambda d: F.struct(F.lit("declares").alias("type"), d.alias("src"), anode.alias("dst"), d.alias("end")))
    out = [F.when(F.col(n).isNotNull(), F.struct(F.lit(kind).alias("type"), anode.alias("src"), F.col(n).alias("dst"), F.col(n).alias("end")))
           for n, kind in USES.items()]
    return F.concat(into, F.array_compact(F.array(*out)))


def asset_neighbourhood(lines: DataFrame, estate, asset_id: str, depth: int) -> DataFrame:
    """The edges of ``neighbourhood``. Only nodes that are no assets are walked and kept: an
    asset is inside if one of its ends is less than ``depth`` hops away."""
    c = F.col
    shared = write_stage(shared_edges(lines, estate), "shared-edges")
    both = shared.select(c("src").alias("a"), c("dst").alias("b")).unionByName(shared.select(c("dst").alias("a"), c("src").alias("b")))
    linked = resource_columns(lines).select("asset_id", F.explode(asset_links()).alias("e"))
    start = linked.where(c("asset_id") == asset_id)

    def touching(ends: DataFrame) -> DataFrame:
        """Ids of the assets that have one of these ends."""
        return linked.select("asset_id", c("e.end").alias("end")).join(ends.select(c("id").alias("end")), "end", "left_semi").select("asset_id")

    seen = write_stage(start.select(c("e.end").alias("id")).distinct().withColumn("hops", F.lit(1)), "near-1")
    for i in range(2, depth + 1):
        last = seen.where(c("hops") == i - 1)
        step = last.join(both, c("id") == c("a")).select(c("b").alias("id"))
        if i > 2:   # over assets that were reached in the last step
            step = step.unionByName(linked.join(touching(seen.where(c("hops") == i - 2)).distinct(), "asset_id", "left_semi").select(c("e.end").alias("id")))
        seen = write_stage(seen.unionByName(step.distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(i))), f"near-{i}")
    ids = seen.select(c("id").alias("inside"))
    close = seen.where(c("hops") < depth).select(c("id").alias("close"))
    own = resource_columns(lines).select("asset_id", "twin", asset_links().alias("links"))
    near = own.select("*", F.explode("links.end").alias("end")).join(close, c("end") == c("close"), "left_semi").drop("end")
    reached = near.unionByName(own.where(c("asset_id") == asset_id)).unionByName(
        own.where("twin").join(near.where("twin").select("asset_id").distinct(), "asset_id", "left_semi"))
    listed = reached.select(F.explode("links").alias("e")).select("e.*").join(ids, c("end") == c("inside"), "left_semi").select("src", "dst", "type")
    among = shared.join(ids, c("src") == c("inside"), "left_semi").join(ids, c("dst") == c("inside"), "left_semi")
    return listed.unionByName(among.select("src", "dst", "type")).distinct()


# --- resource sets --------------------------------------------------------------------
NODES3 = [r + "_node" for r in RESOURCES]


def set_key() -> Column:
    """Text key of an asset's resource set; null when it has none."""
    none = F.expr(" AND ".join(f"{n} IS NULL" for n in NODES3))
    return F.when(~none, F.concat_ws("\u0001", *[F.coalesce(F.col(n), F.lit("")) for n in NODES3]))


def resource_sets(assets: DataFrame) -> DataFrame:
    """Distinct resource sets in use with the number of assets on each."""
    return (assets.where("set_key IS NOT NULL").groupBy("set_key")
            .agg(*[F.first(n).alias(n) for n in NODES3],
                 (F.sum("n") if "n" in assets.columns else F.count(F.lit(1))).alias("set_assets")))


def _subsets():
    c, l, p = NODES3
    return [(c,), (l,), (p,), (c, l), (c, p), (l, p), (c, l, p)]


def _having(nodes) -> str:
    return " AND ".join(f"{n} IS NOT NULL" for n in nodes)


def union_sizes(sets: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Per resource set, how many distinct units its resources touch together.

    ``members`` has distinct (resource, *keys, unit). Sizes of single resources come from
    one aggregate. Intersections are only computed for combinations that occur, starting
    from the finest resource and keeping the units the others touch too (semi-joins).
    """
    terms = []
    for subset in _subsets():
        holders = sets.where(_having(subset)).select("set_key", *subset)
        m = members.withColumnRenamed("resource", subset[0])
        if len(subset) > 1:
            m = holders.select(*subset).distinct().join(m, subset[0])
            for other in subset[1:]:
                m = m.join(members.withColumnRenamed("resource", other), [other, *keys, "unit"], "left_semi")
        sign = 1 if len(subset) % 2 else -1
        n = m.groupBy(*subset, *keys).agg((F.count(F.lit(1)) * sign).alias("n"))
        terms.append(holders.join(n, list(subset)).select("set_key", *keys, "n"))
    total = reduce(DataFrame.unionByName, terms)
    return total.groupBy("set_key", *keys).agg(F.sum("n").alias("n"))


def group_sizes(sets: DataFrame) -> DataFrame:
    """Assets sharing at least one unit of change with each resource set, by inclusion
    and exclusion over sums of the per-set counts."""
    terms = []
    for subset in _subsets():
        have = sets.where(_having(subset))
        n = have.groupBy(*subset).agg(F.sum("set_assets").alias("n"))
        sign = 1 if len(subset) % 2 else -1
        terms.append(have.select("set_key", *subset).join(n, list(subset))
                     .select("set_key", (F.col("n") * sign).alias("n")))
    return (reduce(DataFrame.unionByName, terms).groupBy("set_key")
            .agg(F.sum("n").alias("group_size")))


def attach(assets: DataFrame, per_set: DataFrame) -> DataFrame:
    """Join per-set columns back; assets without any resource spread over all tasks
    instead of meeting in one."""
    right = per_set.withColumnRenamed("set_key", "r_key")
    return assets.join(right, spread_nulls(F.col("set_key"), spreader(assets)) == F.col("r_key"), "left").drop("r_key")


def spreader(assets: DataFrame) -> Column:
    """What rows without a join key are spread by: any column of many values."""
    return F.col("gkey" if "gkey" in assets.columns else "asset_id")


# --- centrality -----------------------------------------------------------------------
def dependents(assets: DataFrame, estate) -> DataFrame:
    """Distinct (resource, kind, unit) behind each unit of change: applications, their
    services, and business units. Pairs are reduced before services are added."""
    direct = (assets.where("application IS NOT NULL").select(
        F.explode(resource_array()).alias("resource"), "application", "business_unit").distinct()
        .repartition("resource"))  # what follows stays with its resource
    pairs = direct.select("resource", "application").distinct()
    apps = pairs.select("resource", F.lit("application").alias("kind"), F.col("application").alias("unit"))
    services = (pairs.join(estate.services, pairs.application == F.col("app_id"))
                .select("resource", F.lit("service").alias("kind"), F.col("service").alias("unit")).distinct())
    units = (direct.where("business_unit IS NOT NULL AND business_unit NOT IN ('', 'unassigned')")
             .select("resource", F.lit("business-unit").alias("kind"), F.col("business_unit").alias("unit")).distinct())
    return apps.unionByName(services).unionByName(units)


@dataclass
class Coupling:
    """What the units of change add up to: one row per resource set, application and
    algorithm, and the estate's peak."""
    per_set: DataFrame       # sets with a certificate: set_key, certificate_node, group_size, set_apps, set_services, set_units
    joint: DataFrame         # the other sets, stored apart so that their real size is known
    own: DataFrame           # o_app, own_services
    users: DataFrame         # g_node, algorithm_users
    peak: DataFrame          # one row


def links(parts: list[DataFrame]) -> DataFrame:
    """What coupling reads of assets, counted: nodes, application and business unit. Assets
    with a certificate are mostly alone with it and are written as they are."""
    by = [*NODES3, "algorithm_node", "application", "business_unit"]
    a = reduce(DataFrame.unionByName, [resource_columns(p).select(*by) for p in parts])
    few = a.where("certificate_node IS NULL").groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    many = a.where("certificate_node IS NOT NULL").withColumn("n", F.lit(1).cast("bigint"))
    return write_stage(few.unionByName(many), "links").withColumn("set_key", set_key())


def shared_resources(sets: DataFrame) -> DataFrame:
    """Resources that occur together with another one in some set. A set of one other
    resource is the only one that has it, so its numbers are the resource's own."""
    nodes = resource_array()
    return sets.where(F.size(nodes) > 1).select(F.explode(nodes).alias("shared")).distinct()


def split_sets(sets: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets of one unshared resource, with it, and the others."""
    one = sets.where(F.size(resource_array()) == 1).withColumn("resource", F.get(resource_array(), F.lit(0)))
    alone = one.join(shared, F.col("resource") == F.col("shared"), "left_anti")
    joint = one.join(shared, F.col("resource") == F.col("shared"), "left_semi").drop("resource")
    return alone, joint.unionByName(sets.where(F.size(resource_array()) > 1))


def per_set_sizes(sets: DataFrame, members: DataFrame, names: dict[str, str]) -> DataFrame:
    """Per resource set its ``group_size`` and how many units of each kind its resources
    touch together; ``names`` gives the column of a kind. ``members`` is dealt by resource."""
    count_of = lambda kind, n: F.coalesce(F.sum(F.when(F.col("kind") == kind, n)), F.lit(0))
    shared = write_stage(shared_resources(sets), "shared")
    alone, joint = split_sets(sets, shared)
    single = members.groupBy("resource").agg(*[count_of(k, F.lit(1).cast("bigint")).alias(v) for k, v in names.items()])
    alone = alone.select("set_key", "certificate_node", "resource", F.col("set_assets").alias("group_size")).join(single, "resource", "left").drop("resource")
    joint = write_stage(joint, "joint-sets")
    few = write_stage(members.join(shared, F.col("resource") == F.col("shared"), "left_semi"), "joint-members")
    sizes = union_sizes(joint, few, ["kind"]).groupBy("set_key").agg(*[count_of(k, F.col("n")).alias(v) for k, v in names.items()])
    joint = joint.select("set_key", "certificate_node").join(group_sizes(joint), "set_key").join(sizes, "set_key", "left")
    return alone.unionByName(joint)


def coupling(linked: DataFrame, estate) -> Coupling:
    """Distinct applications, services and business units coupled through shared units of
    change, sibling counts, and the peak of the first two."""
    sets = write_stage(resource_sets(linked), "sets")
    names = {"application": "set_apps", "service": "set_services", "business-unit": "set_units"}
    every = write_stage(per_set_sizes(sets, dependents(linked, estate), names), "coupling-all")
    per_set = write_stage(every.where("certificate_node IS NOT NULL"), "coupling")
    joint = write_stage(every.where("certificate_node IS NULL"), "coupling-joint")
    drop_stage(sets, every)
    # An asset without any unit of change has only its own application and services. Small
    # tables are written, so that their real size spares the assets a shuffle.
    own = write_stage(estate.services.groupBy(F.col("app_id").alias("o_app")).agg(
        F.count_distinct("service").alias("own_services")), "own-services")
    users = write_stage(linked.where("algorithm_node IS NOT NULL").groupBy(F.col("algorithm_node").alias("g_node")).agg(
        F.sum("n").alias("algorithm_users")), "algorithm-users")
    zero = F.lit(0)
    alone = linked.where("set_key IS NULL").select("application").distinct().join(own, F.col("application") == F.col("o_app"), "left")
    peak = per_set.unionByName(joint).select((F.coalesce("set_apps", zero) + F.coalesce("set_services", zero)).alias("v")).unionByName(
        alone.select((F.when(F.col("application").isNotNull(), 1).otherwise(0) + F.coalesce("own_services", zero)).alias("v")))
    peak = write_stage(peak.agg(F.max("v").cast("int").alias("peak")), "peak")
    return Coupling(per_set, joint, own, users, peak)


def attach_sets(assets: DataFrame, per_set: DataFrame, joint: DataFrame) -> DataFrame:
    """``attach`` for assets that may be dealt already: sets of a certificate are joined on
    its serial, by which ``by_dealt`` rows lie, the others on their key. A certificate's few
    sets come as a list: a join on serial and key would shuffle the wide rows once more."""
    if "by_file" in assets.columns:   # facts inside a file have no certificate
        return attach(assets, joint.drop("certificate_node"))
    if "by_dealt" not in assets.columns:
        return attach(assets, per_set.unionByName(joint).drop("certificate_node"))
    sizes = [c for c in per_set.columns if c not in ("set_key", "certificate_node")]
    right = per_set.groupBy(F.regexp_replace("certificate_node", "^certificate:", "").alias("r_dealt")).agg(
        F.collect_list(F.struct("set_key", *sizes)).alias("r_sets"))
    joined = assets.join(right, F.col("by_dealt") == F.col("r_dealt"), "left")
    found = F.get(F.filter("r_sets", lambda s: s["set_key"] == F.col("set_key")), F.lit(0))
    return joined.withColumn("r_set", found).select(*assets.columns, *["r_set." + c for c in sizes])


def with_coupling(assets: DataFrame, c: Coupling) -> DataFrame:
    """Distinct applications and services coupled through shared units of change, plus
    the asset's own; normalised by the estate peak; sibling counts."""
    a = resource_columns(assets).withColumn("set_key", set_key())
    joined = attach_sets(a, c.per_set, c.joint)
    joined = joined.join(c.own, spread_nulls(F.col("application"), spreader(a)) == F.col("o_app"), "left").drop("o_app")
    joined = joined.join(c.users, spread_nulls(F.col("algorithm_node"), spreader(a)) == F.col("g_node"), "left").drop("g_node")
    in_set, zero = F.col("set_key").isNotNull(), F.lit(0)
    own_unit = F.when(F.col("business_unit").isNotNull() & ~F.col("business_unit").isin("", "unassigned"), 1).otherwise(0)
    pick = lambda name, alone: F.when(in_set, F.coalesce(name, zero)).otherwise(alone).cast("bigint")
    out = joined.withColumns({
        "affected_applications": pick("set_apps", F.when(F.col("application").isNotNull(), 1).otherwise(0)),
        "affected_services": pick("set_services", F.coalesce("own_services", zero)),
        "affected_business_units": pick("set_units", own_unit),
        "sibling_assets": F.coalesce(F.col("group_size") - 1, zero).cast("bigint"),
        "algorithm_siblings": F.coalesce(F.col("algorithm_users") - 1, zero).cast("bigint"),
        "shared_resources": F.array_compact(F.array(
            F.coalesce("certificate_subject", "certificate_serial"), library_label(), protocol_key())),
    }).withColumn("dependency_centrality", (F.col("affected_applications") + F.col("affected_services")).cast("int"))
    out = out.drop("set_apps", "set_services", "set_units", "group_size", "own_services", "algorithm_users")
    return with_peak_score(out, "dependency_centrality", "dependency_centrality_score", c.peak)


def with_centrality(assets: DataFrame, estate) -> DataFrame:
    """Assets with their coupling."""
    return with_coupling(assets, coupling(links([assets]), estate))


def with_peak_score(df: DataFrame, column: str, name: str, peak: DataFrame | None = None) -> DataFrame:
    """0-100 against the estate peak: a one-row aggregate, cross joined."""
    peak = df.agg(F.max(column).alias("peak")) if peak is None else peak
    score = F.when(F.col("peak") > 0, round_tenth(F.lit(100.0) * F.col(column) / F.col("peak"))).otherwise(0.0)
    return df.crossJoin(F.broadcast(peak)).withColumn(name, score).drop("peak")


def siblings_of(assets: DataFrame, asset_ids: list[str]) -> DataFrame:
    """Explicit coupled assets of the requested ids: output is as large as the answer."""
    a = resource_columns(assets) if "library_node" not in assets.columns else assets
    users = a.select("asset_id", F.explode(resource_array()).alias("resource"))
    focus = users.where(F.col("asset_id").isin(asset_ids)).select(F.col("asset_id").alias("focus"), "resource")
    return (focus.join(users, "resource").where("focus <> asset_id")
            .select("focus", "asset_id").distinct())

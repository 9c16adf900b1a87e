"""Registered queries on the graph, impact and roadmap, with brute-force SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chains, graph, impact, roadmap
from . import oracle_base as o
from .registry import register, scan, text

GRAPH_CTE = o.DECIDE_CTE + """,
svcs AS (SELECT DISTINCT 'app-' || c_nationkey AS app, 'svc-' || c_mktsegment || '-' || (c_nationkey % 5) AS svc FROM customer),
g AS (SELECT *, coalesce(p_container, p_image) AS cont,
    CASE WHEN library <> '' THEN 'library:' || concat_ws('@', library, library_version) END AS lib_node,
    CASE WHEN protocol <> '' THEN 'protocol:' || protocol || '/' || coalesce(protocol_version, 'unspecified') END AS proto_node,
    CASE WHEN p_c_serial <> '' THEN 'certificate:' || p_c_serial END AS cert_node FROM decided),
ar AS (SELECT asset_id, lib_node AS r FROM g WHERE lib_node IS NOT NULL UNION ALL SELECT asset_id, proto_node FROM g WHERE proto_node IS NOT NULL
  UNION ALL SELECT asset_id, cert_node FROM g WHERE cert_node IS NOT NULL),
by_subject AS (SELECT p_c_subject AS dn, last(p_c_serial ORDER BY asset_seq) AS issuer FROM g WHERE p_c_subject <> '' GROUP BY 1),
issued AS (SELECT DISTINCT 'certificate:' || p_c_serial AS src, 'certificate:' || issuer AS dst FROM g JOIN by_subject ON p_c_issuer = dn WHERE p_c_serial <> issuer)"""

EDGES_CTE = GRAPH_CTE + """,
mapped AS (SELECT * FROM g WHERE owner IS NOT NULL),
edges AS (SELECT DISTINCT src, dst, type FROM (
  SELECT 'owner:' || owner AS src, 'application:' || app_id AS dst, 'accountable-for' AS type FROM apps WHERE owner <> 'unassigned'
  UNION ALL SELECT 'application:' || app_id, 'data:' || app_id, 'protects' FROM apps
  UNION ALL SELECT 'application:' || app_id, 'business-function:' || app_id, 'serves' FROM apps WHERE business_function <> ''
  UNION ALL SELECT 'application:' || app, 'service:' || svc, 'runs' FROM svcs
  UNION ALL SELECT 'application:' || app, 'repository:' || repo, 'owns' FROM repos
  UNION ALL SELECT 'application:' || app, 'container:' || cont, 'deploys' FROM conts
  UNION ALL SELECT 'application:' || application, 'repository:' || p_repository, 'owns' FROM mapped WHERE p_repository IS NOT NULL
  UNION ALL SELECT coalesce('repository:' || p_repository, 'application:' || application), 'file:' || p_file, 'contains' FROM mapped
  UNION ALL SELECT 'file:' || p_file, 'crypto-asset:' || asset_id, 'declares' FROM mapped
  UNION ALL SELECT 'application:' || application, 'container:' || cont, 'deploys' FROM mapped WHERE cont IS NOT NULL
  UNION ALL SELECT 'container:' || cont, 'crypto-asset:' || asset_id, 'declares' FROM mapped WHERE cont IS NOT NULL
  UNION ALL SELECT 'crypto-asset:' || asset_id, 'algorithm:' || algorithm, 'uses-algorithm' FROM g WHERE algorithm IS NOT NULL
  UNION ALL SELECT 'crypto-asset:' || asset_id, lib_node, 'provided-by' FROM g WHERE lib_node IS NOT NULL
  UNION ALL SELECT 'crypto-asset:' || asset_id, proto_node, 'negotiates' FROM g WHERE proto_node IS NOT NULL
  UNION ALL SELECT 'crypto-asset:' || asset_id, cert_node, 'bound-to' FROM g WHERE cert_node IS NOT NULL
  UNION ALL SELECT src, dst, 'issued-by' FROM issued)),
nodes AS (SELECT DISTINCT id, type, label FROM (
  SELECT 'application:' || app_id AS id, 'application' AS type, name AS label FROM apps
  UNION ALL SELECT 'owner:' || owner, 'owner', owner FROM apps WHERE owner <> 'unassigned'
  UNION ALL SELECT 'data:' || app_id, 'data', data_classification || ' / ' || data_lifetime_years || 'y' FROM apps
  UNION ALL SELECT 'business-function:' || app_id, 'business-function', business_function FROM apps WHERE business_function <> ''
  UNION ALL SELECT 'service:' || svc, 'service', svc FROM svcs
  UNION ALL SELECT 'repository:' || repo, 'repository', repo FROM repos
  UNION ALL SELECT 'container:' || cont, 'container', cont FROM conts
  UNION ALL SELECT 'repository:' || p_repository, 'repository', p_repository FROM mapped WHERE p_repository IS NOT NULL
  UNION ALL SELECT 'file:' || p_file, 'file', p_file FROM mapped
  UNION ALL SELECT 'container:' || cont, 'container', cont FROM mapped WHERE cont IS NOT NULL
  UNION ALL SELECT 'crypto-asset:' || asset_id, 'crypto-asset', asset_name FROM g
  UNION ALL SELECT 'algorithm:' || algorithm, 'algorithm', kb_name FROM g WHERE algorithm IS NOT NULL
  UNION ALL SELECT lib_node, 'library', concat_ws(' ', library, library_version) FROM g WHERE lib_node IS NOT NULL
  UNION ALL SELECT proto_node, 'protocol', substr(proto_node, 10) FROM g WHERE proto_node IS NOT NULL
  UNION ALL SELECT cert_node, 'certificate', p_c_subject FROM g WHERE cert_node IS NOT NULL))"""

CENTRAL_CTE = GRAPH_CTE + f""",
own_dep AS (SELECT asset_id, 'application' AS kind, application AS unit FROM g WHERE application IS NOT NULL
  UNION ALL SELECT asset_id, 'service', svc FROM g JOIN svcs ON application = app
  UNION ALL SELECT asset_id, 'unit', business_unit FROM g WHERE business_unit NOT IN ('', 'unassigned')),
r_dep AS (SELECT DISTINCT r, kind, unit FROM ar JOIN own_dep USING (asset_id)),
all_dep AS (SELECT asset_id, kind, unit FROM own_dep UNION SELECT asset_id, kind, unit FROM ar JOIN r_dep USING (r)),
dep_n AS (SELECT asset_id, count(*) FILTER (WHERE kind = 'application') AS na, count(*) FILTER (WHERE kind = 'service') AS ns, count(*) FILTER (WHERE kind = 'unit') AS nu FROM all_dep GROUP BY 1),
sib AS (SELECT a.asset_id, count(DISTINCT b.asset_id) - 1 AS n FROM ar a JOIN ar b USING (r) GROUP BY 1),
alg_n AS (SELECT algorithm, count(*) - 1 AS n FROM g WHERE algorithm IS NOT NULL GROUP BY 1),
central AS (SELECT g.*, coalesce(na, 0) AS affected_applications, coalesce(ns, 0) AS affected_services, coalesce(nu, 0) AS affected_business_units,
    coalesce(sib.n, 0) AS sibling_assets, coalesce(alg_n.n, 0) AS algorithm_siblings, CAST(coalesce(na, 0) + coalesce(ns, 0) AS INT) AS dependency_centrality
  FROM g LEFT JOIN dep_n USING (asset_id) LEFT JOIN sib USING (asset_id) LEFT JOIN alg_n ON g.algorithm = alg_n.algorithm),
cpeak AS (SELECT max(dependency_centrality) AS peak FROM central)"""
SCORE = lambda col: o.round_tenth(f"(100.0::DOUBLE * {col} / peak)")

KIND_COLUMNS = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {impact.PLURAL[k]}" for k in impact.KINDS)
GATE_CTE = CENTRAL_CTE + """,
gate AS MATERIALIZED (SELECT *, lib_node IS NOT NULL AND algorithm IS NULL AND migration_decision IN ('UPGRADE', 'HARDEN') AS is_provider,
    coalesce(protocol = 'TLS' AND protocol_version IN ('1.0', '1.1', '1.2') AND recommended_strategy = 'upgrade-protocol', false) AS is_gate,
    coalesce(protocol = 'TLS' AND protocol_version IN ('1.0', '1.1', '1.2') AND recommended_strategy <> 'upgrade-protocol', false) AS waits FROM central),
holder AS (SELECT cert_node AS dst, first(asset_id ORDER BY asset_seq) AS holder_id FROM gate WHERE cert_node IS NOT NULL GROUP BY 1)"""
# Explicit pairs, for queries that list them; counts come from resources.
PREREQ_CTE = GATE_CTE + """,
pairs0 AS (
  SELECT a.asset_id, b.asset_id AS prereq_id, 0 AS k FROM gate a JOIN gate b ON a.lib_node = b.lib_node AND b.is_provider
  UNION ALL SELECT a.asset_id, holder_id, 1 FROM gate a JOIN issued i ON a.cert_node = i.src JOIN holder USING (dst)
  UNION ALL SELECT a.asset_id, b.asset_id, 2 FROM gate a JOIN gate b ON a.proto_node = b.proto_node AND a.waits AND b.is_gate),
pairs AS MATERIALIZED (SELECT asset_id, prereq_id, min(k) AS k FROM pairs0 WHERE asset_id <> prereq_id GROUP BY 1, 2)"""
IMPACT_CTE = GATE_CTE + f""",
mapped AS (SELECT * FROM gate WHERE owner IS NOT NULL),
f_par AS (SELECT DISTINCT p_file AS file, p_repository AS repo, CASE WHEN p_repository IS NULL THEN application END AS app FROM mapped),
repo_apps AS (SELECT repo, app FROM repos UNION SELECT p_repository, application FROM mapped WHERE p_repository IS NOT NULL),
cont_apps AS (SELECT cont, app FROM conts UNION SELECT cont, application FROM mapped WHERE cont IS NOT NULL),
up_app AS (SELECT m.asset_id, r.app FROM mapped m JOIN f_par f ON m.p_file = f.file JOIN repo_apps r ON f.repo = r.repo
  UNION SELECT m.asset_id, f.app FROM mapped m JOIN f_par f ON m.p_file = f.file WHERE f.app IS NOT NULL
  UNION SELECT m.asset_id, c.app FROM mapped m JOIN cont_apps c ON m.cont = c.cont),
own_reach AS (SELECT asset_id, 'file' AS kind, p_file AS unit FROM mapped
  UNION SELECT m.asset_id, 'repository', repo FROM mapped m JOIN f_par f ON m.p_file = f.file WHERE repo IS NOT NULL
  UNION SELECT asset_id, 'container', cont FROM mapped WHERE cont IS NOT NULL
  UNION SELECT asset_id, 'application', app FROM up_app
  UNION SELECT asset_id, 'owner', owner FROM up_app JOIN apps ON app = app_id WHERE owner <> 'unassigned'
  UNION SELECT asset_id, 'business-unit', business_unit FROM up_app JOIN apps ON app = app_id
  UNION SELECT asset_id, 'business-function', business_function FROM up_app JOIN apps ON app = app_id WHERE business_function <> ''
  UNION SELECT asset_id, 'service', svc FROM up_app JOIN svcs USING (app)),
r_reach AS (SELECT DISTINCT r, kind, unit FROM ar JOIN own_reach USING (asset_id)),
reach AS (SELECT asset_id, kind, unit FROM own_reach UNION SELECT asset_id, kind, unit FROM ar JOIN r_reach USING (r)),
reach_n AS (SELECT asset_id, {KIND_COLUMNS}, min(unit) FILTER (WHERE kind = 'application') AS first_application FROM reach GROUP BY 1),
r_months AS (SELECT r, max(migration_months) AS m FROM ar JOIN gate USING (asset_id) GROUP BY 1),
c_months AS (SELECT asset_id, max(m) AS m FROM ar JOIN r_months USING (r) GROUP BY 1),
pki AS MATERIALIZED (SELECT DISTINCT a.asset_id, b.asset_id AS prereq_id, b.migration_months, coalesce(b.is_provider AND b.lib_node = a.lib_node, false) AS via_lib,
    coalesce(b.is_gate AND a.waits AND b.proto_node = a.proto_node, false) AS via_proto
  FROM gate a JOIN issued i ON a.cert_node = i.src JOIN holder USING (dst) JOIN gate b ON b.asset_id = holder_id WHERE a.asset_id <> b.asset_id),
pki_pre AS (SELECT asset_id, count(*) FILTER (WHERE NOT via_lib) AS n, count(*) FILTER (WHERE via_proto AND NOT via_lib) AS both, max(migration_months) AS m FROM pki GROUP BY 1),
pki_unb AS (SELECT prereq_id, count(*) FILTER (WHERE NOT via_lib) AS n, count(*) FILTER (WHERE via_proto AND NOT via_lib) AS both FROM pki GROUP BY 1),
lib_n AS (SELECT lib_node, count(*) AS users, count(*) FILTER (WHERE is_provider) AS providers, list_sort(list({{'m': migration_months, 'id': asset_id}}) FILTER (WHERE is_provider), 'DESC')[:2] AS top
  FROM gate WHERE lib_node IS NOT NULL GROUP BY 1),
proto_n AS (SELECT proto_node, count(*) FILTER (WHERE waits) AS waiters, count(*) FILTER (WHERE is_gate) AS gates, max(migration_months) FILTER (WHERE is_gate) AS m FROM gate WHERE proto_node IS NOT NULL GROUP BY 1),
both_n AS (SELECT lib_node, proto_node, count(*) FILTER (WHERE waits) AS waiters, count(*) FILTER (WHERE is_gate AND is_provider) AS gates FROM gate WHERE lib_node IS NOT NULL AND proto_node IS NOT NULL GROUP BY 1, 2),
pre_n AS (SELECT *, n0 + n1 + n2 AS n FROM (SELECT g.asset_id, coalesce(l.providers, 0) - CASE WHEN is_provider THEN 1 ELSE 0 END AS n0, coalesce(k.n, 0) AS n1,
    CASE WHEN waits THEN coalesce(p.gates, 0) - coalesce(b.gates, 0) - coalesce(k.both, 0) ELSE 0 END AS n2,
    greatest(CASE WHEN l.top[1].id = g.asset_id THEN l.top[2].m ELSE l.top[1].m END, k.m, CASE WHEN waits THEN p.m END) AS m
  FROM gate g LEFT JOIN lib_n l USING (lib_node) LEFT JOIN proto_n p USING (proto_node) LEFT JOIN both_n b ON g.lib_node = b.lib_node AND g.proto_node = b.proto_node LEFT JOIN pki_pre k ON g.asset_id = k.asset_id)),
unb AS (SELECT g.asset_id, CASE WHEN is_provider THEN l.users - 1 ELSE 0 END + coalesce(k.n, 0)
    + CASE WHEN is_gate THEN p.waiters - CASE WHEN is_provider THEN coalesce(b.waiters, 0) ELSE 0 END - coalesce(k.both, 0) ELSE 0 END AS n
  FROM gate g LEFT JOIN lib_n l USING (lib_node) LEFT JOIN proto_n p USING (proto_node) LEFT JOIN both_n b ON g.lib_node = b.lib_node AND g.proto_node = b.proto_node LEFT JOIN pki_unb k ON g.asset_id = k.prereq_id),
impacts AS MATERIALIZED (SELECT g.*, {', '.join(f'coalesce({c}, 0) AS {c}' for c in impact.PLURAL.values())}, first_application,
    coalesce(pre_n.n, 0) AS prerequisites, coalesce(n0, 0) AS provider_prerequisites, coalesce(n1, 0) AS pki_prerequisites, coalesce(n2, 0) AS protocol_prerequisites,
    coalesce(unb.n, 0) AS unblocks, greatest(migration_months, coalesce(c_months.m, 0)) + coalesce(pre_n.m, 0) AS coordinated_effort_months,
    coalesce(pre_n.m, 0) AS prerequisite_months, sibling_assets AS dependent_assets,
    coalesce(applications, 0) + coalesce(services, 0) + coalesce(repositories, 0) + coalesce(containers, 0) + CASE WHEN cert_node IS NOT NULL THEN 1 ELSE 0 END AS blast_radius
  FROM gate g LEFT JOIN reach_n USING (asset_id) LEFT JOIN c_months USING (asset_id) LEFT JOIN pre_n USING (asset_id) LEFT JOIN unb USING (asset_id)),
ipeak AS (SELECT max(blast_radius) AS peak FROM impacts)"""

PHASED = """CASE WHEN recommended_strategy IN ('verify-manually', 'determine-role-then-migrate') THEN 1
  WHEN kb_class = 'classically_broken' OR p_c_days < 0 OR t_key OR migration_decision = 'UPGRADE' OR recommended_strategy IN ('renew-certificate', 'rotate-and-externalise-key') THEN 2
  WHEN unblocks > 0 OR recommended_strategy IN ('upgrade-protocol', 'strengthen-parameters') OR (crypto_agility = 'low' AND quantum_vulnerable) THEN 3
  WHEN migration_decision IN ('HYBRID', 'PQC-ONLY') THEN CASE WHEN pqc_readiness = 'native' AND crypto_agility = 'high' AND coalesce(business_criticality, '') <> 'mission-critical' THEN 4 ELSE 5 END
  WHEN migration_decision = 'HARDEN' THEN 3 ELSE 5 END"""
# Four rounds of pulling blockers forward; the last one must change nothing.
ROUNDS = "".join(f""",
lib_min{i} AS (SELECT lib_node, min(n) AS n FROM round{i - 1} WHERE n > 1 AND lib_node IS NOT NULL GROUP BY 1),
proto_min{i} AS (SELECT proto_node, min(n) AS n FROM round{i - 1} WHERE n > 1 AND waits GROUP BY 1),
pki_min{i} AS (SELECT prereq_id, min(n) AS n FROM pki JOIN round{i - 1} USING (asset_id) WHERE n > 1 GROUP BY 1),
round{i} AS MATERIALIZED (SELECT r.* REPLACE (CASE WHEN r.n = 1 THEN 1 ELSE least(r.n, CASE WHEN is_provider THEN l.n END, CASE WHEN is_gate THEN p.n END, k.n) END AS n)
  FROM round{i - 1} r LEFT JOIN lib_min{i} l USING (lib_node) LEFT JOIN proto_min{i} p USING (proto_node) LEFT JOIN pki_min{i} k ON r.asset_id = k.prereq_id)""" for i in range(1, 5))
ITEMS_CTE = IMPACT_CTE + f""",
placed AS MATERIALIZED (SELECT *, {PHASED} AS n0_phase FROM impacts WHERE migration_decision <> 'RETAIN'),
round0 AS (SELECT asset_id, lib_node, proto_node, is_provider, is_gate, waits, n0_phase AS n FROM placed){ROUNDS},
items AS (SELECT p.*, 'PH' || n0_phase AS placed_phase, 'PH' || r.n AS phase FROM placed p JOIN round4 r USING (asset_id))"""


# --- graph -------------------------------------------------------------------------------
@register("graph_nodes", o.query(EDGES_CTE, "SELECT id, type, label FROM nodes"))
def graph_nodes(spark, sf) -> DataFrame:
    return scan(spark, sf).nodes.select("id", "type", "label")


@register("graph_edges", o.query(EDGES_CTE, "SELECT src, dst, type FROM edges"))
def graph_edges(spark, sf) -> DataFrame:
    return scan(spark, sf).edges


@register("graph_counts", o.query(EDGES_CTE, """
SELECT 'node' AS kind, type, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY ALL"""))
def graph_counts(spark, sf) -> DataFrame:
    s = scan(spark, sf)
    if s.derived:
        return graph.counted_parts(s.asset_parts, s.estate)
    return graph.graph_counts(s.nodes, s.edges)


@register("certificate_chain", o.query(GRAPH_CTE, "SELECT src, dst FROM issued"))
def certificate_chain(spark, sf) -> DataFrame:
    return graph.issuer_edges(scan(spark, sf).assets)


@register("owner_reach", o.query(EDGES_CTE, """
, walk AS (SELECT 'owner:' || owner AS seed, 'owner:' || owner AS id, 0 AS hops FROM apps WHERE owner <> 'unassigned' GROUP BY ALL
  UNION SELECT seed, dst, hops + 1 FROM walk JOIN edges ON id = src WHERE hops < 4)
, nearest AS (SELECT seed, id, min(hops) AS hops FROM walk GROUP BY 1, 2)
SELECT seed, hops, count(*) AS n FROM nearest WHERE hops > 0 GROUP BY ALL"""))
def owner_reach(spark, sf) -> DataFrame:
    s = scan(spark, sf)
    return graph.reach_counts(s.asset_parts, s.estate, "owner", 4)


@register("asset_neighbourhood", o.query(EDGES_CTE, """
, start AS (SELECT 'crypto-asset:' || min(asset_id) AS id FROM g), both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)
, walk AS (SELECT id, 0 AS hops FROM start UNION SELECT b, hops + 1 FROM walk JOIN both_ways ON id = a WHERE hops < 2), ids AS (SELECT DISTINCT id FROM walk)
SELECT src, dst, type FROM edges WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids)"""))
def asset_neighbourhood(spark, sf) -> DataFrame:
    s = scan(spark, sf)
    lines = graph.asset_lines(s.asset_parts)
    focus = lines.agg(F.min("asset_id")).first()[0]
    return graph.asset_neighbourhood(lines, s.estate, focus, 2)


@register("dependency_centrality", o.query(CENTRAL_CTE, f"""
SELECT asset_id, affected_applications, affected_services, affected_business_units, sibling_assets, algorithm_siblings, dependency_centrality,
  {SCORE('dependency_centrality')} AS dependency_centrality_score FROM central CROSS JOIN cpeak"""))
def dependency_centrality(spark, sf) -> DataFrame:
    return scan(spark, sf).central.select(
        "asset_id", "affected_applications", "affected_services", "affected_business_units", "sibling_assets",
        "algorithm_siblings", "dependency_centrality", "dependency_centrality_score")


@register("decision_notes", o.query(CENTRAL_CTE, """
SELECT asset_id, concat_ws('; ', CASE WHEN recommended_strategy = 'determine-role-then-migrate' THEN 'held-until-role-known' END,
  CASE WHEN migration_decision IN ('HYBRID', 'PQC-ONLY') AND classical_risk IN ('critical', 'high') THEN 'classical-risk-first' END,
  CASE WHEN mosca_urgency IN ('already-late', 'critical') THEN 'window-closed' END,
  CASE WHEN dependency_centrality >= 5 THEN 'high-coupling' END, CASE WHEN crypto_agility = 'low' THEN 'longer-lead-time' END) AS decision_notes FROM central"""))
def decision_notes(spark, sf) -> DataFrame:
    codes = F.transform("decision_notes", lambda n: F.regexp_replace(n, "^window-closed-by-.*$", "window-closed"))
    return scan(spark, sf).decided.select("asset_id", F.array_join(codes, "; ").alias("decision_notes"))


# --- impact ------------------------------------------------------------------------------
@register("impact_reach", o.query(IMPACT_CTE, f"""
SELECT asset_id, {', '.join(impact.PLURAL.values())}, dependent_assets, blast_radius, {SCORE('blast_radius')} AS blast_radius_score FROM impacts CROSS JOIN ipeak"""))
def impact_reach(spark, sf) -> DataFrame:
    return scan(spark, sf).impacts.select("asset_id", *impact.PLURAL.values(), "dependent_assets", "blast_radius", "blast_radius_score")


@register("impact_prerequisites", o.query(IMPACT_CTE, """
SELECT asset_id, provider_prerequisites, pki_prerequisites, protocol_prerequisites, prerequisites, unblocks FROM impacts"""))
def impact_prerequisites(spark, sf) -> DataFrame:
    return scan(spark, sf).impacts.select("asset_id", "provider_prerequisites", "pki_prerequisites",
                                          "protocol_prerequisites", "prerequisites", "unblocks")


@register("impact_effort", o.query(IMPACT_CTE, "SELECT asset_id, migration_months, prerequisite_months, coordinated_effort_months FROM impacts"))
def impact_effort(spark, sf) -> DataFrame:
    return scan(spark, sf).impacts.select("asset_id", "migration_months", "prerequisite_months", "coordinated_effort_months")


UNITS = """
, labels AS (SELECT asset_id, r, CASE WHEN r LIKE 'library:%' THEN replace(substr(r, 9), '@', ' ') WHEN r LIKE 'protocol:%' THEN substr(r, 10) ELSE p_c_subject END AS unit
  FROM ar JOIN impacts USING (asset_id)),
base AS (SELECT unit, count(*) AS assets, max(blast_radius) AS max_blast_radius FROM labels JOIN impacts USING (asset_id) GROUP BY 1),
reached AS (SELECT unit, count(DISTINCT x.unit_) FILTER (WHERE kind = 'application') AS applications, count(DISTINCT x.unit_) FILTER (WHERE kind = 'service') AS services,
    count(DISTINCT x.unit_) FILTER (WHERE kind = 'owner') AS owners
  FROM labels JOIN (SELECT asset_id, kind, unit AS unit_ FROM reach WHERE kind IN ('application', 'service', 'owner')) x USING (asset_id) GROUP BY 1)"""


@register("change_units", o.query(IMPACT_CTE, UNITS + """
SELECT unit, assets, coalesce(applications, 0) AS applications, coalesce(services, 0) AS services, coalesce(owners, 0) AS owners, max_blast_radius
FROM base LEFT JOIN reached USING (unit) ORDER BY assets DESC, unit LIMIT 20"""))
def change_units(spark, sf) -> DataFrame:
    s = scan(spark, sf)
    return impact.change_units(s.impacts, s.estate)


@register("gating_assets", o.query(IMPACT_CTE, """
SELECT asset_id, asset_name, migration_decision, unblocks, applications FROM impacts WHERE unblocks > 0 ORDER BY unblocks DESC, asset_id LIMIT 15"""))
def gating_assets(spark, sf) -> DataFrame:
    return impact.gating_assets(scan(spark, sf).impacts)


@register("widest_blast_radius", o.query(IMPACT_CTE, f"""
SELECT asset_id, asset_name, migration_decision, blast_radius, {SCORE('blast_radius')} AS blast_radius_score FROM impacts CROSS JOIN ipeak
ORDER BY blast_radius DESC, asset_id LIMIT 15"""))
def widest_blast_radius(spark, sf) -> DataFrame:
    return impact.widest(scan(spark, sf).impacts)


@register("owner_rollup", o.query(IMPACT_CTE, """
, o AS (SELECT asset_id, unit AS owner FROM reach WHERE kind = 'owner'),
oa AS (SELECT owner, count(DISTINCT unit) AS applications FROM o JOIN reach USING (asset_id) WHERE kind = 'application' GROUP BY 1)
SELECT o.owner, count(*) AS assets, any_value(oa.applications) AS applications, max(coordinated_effort_months) AS longest_coordinated_months
FROM o JOIN impacts USING (asset_id) JOIN oa ON o.owner = oa.owner GROUP BY 1"""))
def owner_rollup(spark, sf) -> DataFrame:
    s = scan(spark, sf)
    return impact.owner_rollup(s.impacts, s.estate)


@register("certificate_critical_path", o.query(PREREQ_CTE, """
, pki AS (SELECT asset_id, prereq_id FROM pairs0 WHERE k = 1 AND asset_id <> prereq_id),
walk AS (SELECT asset_id, asset_id AS head, [asset_id] AS path FROM g
  UNION ALL SELECT w.asset_id, p.prereq_id, list_prepend(p.prereq_id, w.path) FROM walk w JOIN pki p ON w.head = p.asset_id
  WHERE NOT list_contains(w.path, p.prereq_id)),
best AS (SELECT asset_id, path, row_number() OVER (PARTITION BY asset_id ORDER BY len(path) DESC, array_to_string(path, '>')) AS n FROM walk)
SELECT asset_id, CAST(len(path) AS INT) AS length, array_to_string(path, '>') AS path FROM best WHERE n = 1"""))
def certificate_critical_path(spark, sf) -> DataFrame:
    a = scan(spark, sf).gated
    paths = impact.critical_paths(impact.pki_pairs(a), a.select("asset_id"))
    return paths.select("asset_id", "length", F.array_join("path", ">").alias("path"))


GATES_CTE = GATE_CTE + """,
gates AS MATERIALIZED (SELECT lib_node AS resource, asset_id, asset_name, 'provider' AS kind FROM gate WHERE is_provider UNION ALL SELECT proto_node, asset_id, asset_name, 'protocol' FROM gate WHERE is_gate
  UNION ALL SELECT dst, holder_id, asset_name, 'pki' FROM holder JOIN gate ON asset_id = holder_id)"""


@register("prerequisite_users", o.query(GATES_CTE, """
, wanted AS (SELECT asset_id, lib_node AS resource, 'provider' AS kind FROM gate WHERE lib_node IS NOT NULL UNION ALL SELECT asset_id, dst, 'pki' FROM gate JOIN issued ON cert_node = src
  UNION ALL SELECT asset_id, proto_node, 'protocol' FROM gate WHERE waits)
SELECT asset_id, resource, kind FROM wanted WHERE resource IN (SELECT resource FROM gates)"""))
def prerequisite_users(spark, sf) -> DataFrame:
    """Which assets wait for which library, issuer or protocol."""
    return chains.prerequisite_tables(scan(spark, sf).gated)[0]


@register("prerequisite_gates", o.query(GATES_CTE, "SELECT resource, asset_id AS prereq_id, asset_name AS prereq_name, kind FROM gates"))
def prerequisite_gates(spark, sf) -> DataFrame:
    """Which assets, by name, gate a library, issuer or protocol."""
    return chains.prerequisite_tables(scan(spark, sf).gated)[1]


@register("critical_path_steps", o.query(GATE_CTE, """
, members AS MATERIALIZED (SELECT lib_node AS resource, asset_id FROM gate WHERE is_provider UNION ALL SELECT proto_node, asset_id FROM gate WHERE is_gate UNION ALL SELECT dst, holder_id FROM holder),
sizes AS (SELECT resource, count(*) AS n FROM members GROUP BY 1),
wanted AS (SELECT asset_id, lib_node AS resource FROM gate WHERE lib_node IS NOT NULL UNION ALL SELECT asset_id, dst FROM gate JOIN issued ON cert_node = src UNION ALL SELECT asset_id, proto_node FROM gate WHERE waits),
waiting AS MATERIALIZED (SELECT w.asset_id, w.resource, m.asset_id IS NOT NULL AS own FROM wanted w JOIN sizes s USING (resource) LEFT JOIN members m ON w.resource = m.resource AND w.asset_id = m.asset_id
  WHERE m.asset_id IS NULL OR s.n > 1),
links0 AS MATERIALIZED (SELECT DISTINCT m.resource, w.resource AS nxt FROM members m JOIN waiting w USING (asset_id) WHERE m.resource <> w.resource),
closure AS (SELECT resource, nxt FROM links0 UNION SELECT c.resource, l.nxt FROM closure c JOIN links0 l ON c.nxt = l.resource),
loops AS (SELECT a.resource, max(greatest(a.nxt, a.resource)) AS step FROM closure a JOIN closure b ON a.resource = b.nxt AND a.nxt = b.resource WHERE a.resource <> a.nxt GROUP BY 1),
steps AS MATERIALIZED (SELECT s.resource, coalesce(step, s.resource) AS step, step IS NOT NULL AS looped FROM sizes s LEFT JOIN loops USING (resource)),
links AS MATERIALIZED (SELECT DISTINCT a.step, b.step AS next_step FROM links0 JOIN steps a USING (resource) JOIN steps b ON nxt = b.resource WHERE a.step <> b.step),
d AS (SELECT step, 1 AS n, looped FROM steps UNION SELECT l.step, d.n + 1, d.looped FROM d JOIN links l ON l.next_step = d.step),
depth AS MATERIALIZED (SELECT step, max(n) AS n, bool_or(looped) AS looped FROM d GROUP BY 1),
ahead AS (SELECT l.step, min(next_step) AS next_step FROM links l JOIN depth a USING (step) JOIN depth b ON l.next_step = b.step WHERE a.n = b.n + 1 GROUP BY 1),
own AS (SELECT asset_id, step, n AS length, next_step AS first_step, depth.looped FROM members JOIN steps USING (resource) JOIN depth USING (step) LEFT JOIN ahead USING (step)),
other AS (SELECT asset_id, step, n + 1 AS length, step AS first_step, depth.looped FROM waiting JOIN steps USING (resource) JOIN depth USING (step) WHERE NOT own AND (asset_id, step) NOT IN (SELECT (asset_id, step) FROM own)),
best AS (SELECT asset_id, max(length) AS length, bool_or(looped) AS cyclic, first(first_step ORDER BY length DESC, coalesce(first_step, '')) AS first_step FROM (SELECT * FROM own UNION ALL SELECT * FROM other) GROUP BY 1)
SELECT g.asset_id, CAST(coalesce(length, 1) AS INT) AS length, first_step, coalesce(cyclic, false) AS cyclic FROM gate g LEFT JOIN best USING (asset_id)"""))
def critical_path_steps(spark, sf) -> DataFrame:
    """Length of the longest prerequisite chain of every asset, over all three kinds."""
    a = scan(spark, sf).gated
    return chains.critical_lengths(a)[0]


# --- roadmap -----------------------------------------------------------------------------
@register("roadmap_placement", o.query(ITEMS_CTE, "SELECT asset_id, placed_phase FROM items"))
def roadmap_placement(spark, sf) -> DataFrame:
    return scan(spark, sf).items.select("asset_id", "placed_phase")


@register("roadmap_phases_hoisted", o.query(ITEMS_CTE, "SELECT asset_id, phase, migration_priority AS priority, priority_band AS band, unblocks FROM items"))
def roadmap_phases_hoisted(spark, sf) -> DataFrame:
    return scan(spark, sf).items.select("asset_id", "phase", "priority", "band", "unblocks")


@register("roadmap_listed_items", o.query(ITEMS_CTE, """
, r AS (SELECT asset_id, phase, unblocks, migration_priority AS priority, row_number() OVER (PARTITION BY phase ORDER BY unblocks DESC, migration_priority DESC, asset_id) AS rank FROM items)
SELECT * FROM r WHERE rank <= 60"""))
def roadmap_listed_items(spark, sf) -> DataFrame:
    return roadmap.listed_items(scan(spark, sf).items).select("asset_id", "phase", "unblocks", "priority", "rank")


@register("roadmap_phase_rollup", o.query(ITEMS_CTE, """
, phases AS (SELECT * FROM (VALUES ('PH0'), ('PH1'), ('PH2'), ('PH3'), ('PH4'), ('PH5'), ('PH6')) AS t(phase))
SELECT phases.phase, count(asset_id) AS asset_count, count(DISTINCT application) AS applications, coalesce(max(coordinated_effort_months), 0) AS longest_coordinated_months,
  count(*) FILTER (WHERE priority_band = 'P0') AS p0, count(*) FILTER (WHERE priority_band = 'P1') AS p1, count(*) FILTER (WHERE priority_band = 'P2') AS p2, count(*) FILTER (WHERE priority_band = 'P3') AS p3,
  count(*) FILTER (WHERE migration_decision = 'HARDEN') AS harden, count(*) FILTER (WHERE migration_decision = 'UPGRADE') AS upgrade,
  count(*) FILTER (WHERE migration_decision = 'HYBRID') AS hybrid, count(*) FILTER (WHERE migration_decision = 'PQC-ONLY') AS pqc_only,
  greatest(0, count(asset_id) - 60) AS items_truncated
FROM phases LEFT JOIN items USING (phase) GROUP BY 1"""))
def roadmap_phase_rollup(spark, sf) -> DataFrame:
    return roadmap.phase_rollup(scan(spark, sf).items).drop("phase_name", "duration", "unblocked")


@register("roadmap_band_rollup", o.query(ITEMS_CTE, """
, d AS (SELECT priority_band AS band, migration_decision || '=' || count(*) AS t FROM items GROUP BY priority_band, migration_decision),
p AS (SELECT priority_band AS band, phase || '=' || count(*) AS t FROM items GROUP BY priority_band, phase)
SELECT priority_band AS band, count(*) AS assets, max(coordinated_effort_months) AS longest_coordinated_months, count(DISTINCT application) AS applications,
  (SELECT string_agg(t, ', ' ORDER BY t) FROM d WHERE d.band = priority_band) AS decisions, (SELECT string_agg(t, ', ' ORDER BY t) FROM p WHERE p.band = priority_band) AS phases
FROM items GROUP BY 1"""))
def roadmap_band_rollup(spark, sf) -> DataFrame:
    return roadmap.band_rollup(scan(spark, sf).items).where("assets > 0")


@register("roadmap_top_of_band", o.query(ITEMS_CTE, """
, r AS (SELECT asset_id, priority_band AS band, migration_priority AS priority, row_number() OVER (PARTITION BY priority_band ORDER BY migration_priority DESC, asset_id) AS rank FROM items)
SELECT * FROM r WHERE rank <= 15"""))
def roadmap_top_of_band(spark, sf) -> DataFrame:
    return roadmap.top_of_band(scan(spark, sf).items).select("asset_id", "band", "priority", "rank")


@register("enablement_waves", o.query(ITEMS_CTE, """
, named AS (SELECT * FROM impacts WHERE first_application IS NOT NULL),
lib_apps AS (SELECT lib_node, first_application AS app, count(*) AS n FROM named WHERE lib_node IS NOT NULL GROUP BY 1, 2),
proto_apps AS (SELECT DISTINCT proto_node, first_application AS app FROM named WHERE waits AND proto_node IS NOT NULL),
f AS (SELECT asset_id, count(*) AS n FROM (
  SELECT g.asset_id, app FROM impacts g JOIN lib_apps USING (lib_node) WHERE is_provider AND n > CASE WHEN first_application = app THEN 1 ELSE 0 END
  UNION SELECT g.asset_id, app FROM impacts g JOIN proto_apps USING (proto_node) WHERE is_gate
  UNION SELECT prereq_id, first_application FROM pki JOIN named USING (asset_id)) GROUP BY 1)
SELECT asset_id AS gating_asset, asset_name AS gating_asset_name, phase, migration_decision AS decision, recommended_strategy AS strategy,
  unblocks AS dependent_assets, coalesce(f.n, 0) AS applications, coordinated_effort_months AS months FROM items LEFT JOIN f USING (asset_id) WHERE unblocks > 0"""))
def enablement_waves(spark, sf) -> DataFrame:
    s = scan(spark, sf)
    return roadmap.enablement_waves(s.items, s.impacts).drop("change_units")


@register("application_rollup", o.query(IMPACT_CTE, """
SELECT application, a.name, a.owner, a.business_unit, count(*) AS assets, count(*) FILTER (WHERE quantum_vulnerable) AS quantum_vulnerable,
  count(*) FILTER (WHERE migration_decision = 'RETAIN') AS retain, count(*) FILTER (WHERE migration_decision = 'HARDEN') AS harden,
  count(*) FILTER (WHERE migration_decision = 'UPGRADE') AS upgrade, count(*) FILTER (WHERE migration_decision = 'HYBRID') AS hybrid,
  count(*) FILTER (WHERE migration_decision = 'PQC-ONLY') AS pqc_only, count(*) FILTER (WHERE priority_band = 'P0') AS p0, count(*) FILTER (WHERE priority_band = 'P1') AS p1,
  max(migration_priority) AS max_priority, max(coordinated_effort_months) AS effort_months,
  first(mosca_urgency ORDER BY CASE mosca_urgency WHEN 'already-late' THEN 0 WHEN 'critical' THEN 1 WHEN 'urgent' THEN 2 WHEN 'plan-now' THEN 3 WHEN 'monitor' THEN 4 ELSE 5 END) AS worst_urgency
FROM impacts JOIN apps a ON application = a.app_id GROUP BY ALL"""))
def application_rollup(spark, sf) -> DataFrame:
    s = scan(spark, sf)
    return roadmap.application_rollup(s.impacts, s.estate.applications)


@register("roadmap_totals", o.query(ITEMS_CTE, """
SELECT count(*) AS assets, count(*) AS in_scope, count(*) FILTER (WHERE migration_decision <> 'RETAIN') AS scheduled, count(*) FILTER (WHERE migration_decision = 'RETAIN') AS no_action_required,
  count(*) FILTER (WHERE quantum_vulnerable) AS quantum_vulnerable, count(*) FILTER (WHERE quantum_class = 'classically_broken') AS classically_broken,
  count(*) FILTER (WHERE priority_band = 'P0') AS p0, count(*) FILTER (WHERE priority_band = 'P1') AS p1, count(*) FILTER (WHERE priority_band = 'P2') AS p2,
  count(*) FILTER (WHERE priority_band = 'P3') AS p3, (SELECT count(*) FROM items WHERE unblocks > 0) AS gating_assets FROM impacts"""))
def roadmap_totals(spark, sf) -> DataFrame:
    s = scan(spark, sf)
    return roadmap.totals(s.impacts, s.items)

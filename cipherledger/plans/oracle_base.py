"""ANSI SQL for the stages, written from their definitions and chained as CTEs.

It shares with the Spark code only the fixed rows and the estate arithmetic; merging,
axes, decisions and graph measures are formulated on their own, often by brute force.
"""

from __future__ import annotations

from ..functions.columns import PRIVATE_KEY_MARKERS
from ..knowledge import algorithms as kb
from ..knowledge import libraries as lib
from ..knowledge import policy as pol
from ..knowledge.tables import literal, values_sql
from ..operators.certificates import AGREEMENT, EC_KEY_BITS, PUBLIC_KEY_OIDS, SIGNATURE_OIDS
from ..operators.decisions import RULE_CITATIONS, RULE_STEPS
from ..operators.normalize import CAN_ESTABLISH_ROLE, DEMONSTRATES_USE
from ..sources import driver_tables as dt

AS_OF = f"TIMESTAMP '{dt.AS_OF}'"


def cmap(expr: str, mapping: dict, otherwise: str = "NULL") -> str:
    arms = " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in mapping.items())
    return f"CASE {expr} {arms} ELSE {otherwise} END"


def inlist(values) -> str:
    return "(" + ", ".join(literal(v) for v in values) + ")"


def key(tag: str, *cols: str) -> str:
    parts = [f"coalesce('=' || CAST({c} AS VARCHAR), '')" for c in cols]
    return " || chr(1) || ".join([f"'{tag}'", *parts])


def _cert_columns(sql: dict) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in sql.items())


CURVES = dict(kb.CURVE_STRENGTH)
STEPS = " ".join(f"WHEN key_size >= {s} THEN {b}" for s, b in reversed(kb.MODULUS_STRENGTH))
BITS = (f"CASE WHEN kb_family IS NULL THEN NULL ELSE coalesce({cmap('lower(trim(curve))', CURVES)}, "
        f"CASE WHEN key_size <> 0 AND kb_family IN {inlist(kb.MODULUS_FAMILIES)} THEN CASE {STEPS} ELSE {kb.MODULUS_FLOOR_BITS} END "
        f"WHEN key_size <> 0 AND kb_family = 'AES' AND key_size IN (128, 192, 256) THEN key_size END, kb_bits) END")
ORDER = "cr DESC, prim, file, det_rank, ord, sub, line"


def first(col: str, where: str | None = None, order: str = ORDER) -> str:
    f = f" FILTER (WHERE {where})" if where else ""
    return f"first({col} ORDER BY {order}){f}"


def version_list(v: str) -> str:
    return f"list_transform(string_split({v}, '.'), lambda x: CAST(x AS BIGINT))"


def capability(version: str) -> str:
    return (f"CASE WHEN lib_pqc IS NULL THEN 'unknown' WHEN lib_pqc = 'native' AND lib_since IS NOT NULL AND {version} IS NOT NULL "
            f"AND {version} <> '' AND {version_list(version)} < {version_list('lib_since')} THEN 'provider' ELSE lib_pqc END")


DET_COLUMNS = [c for c in dt.DETECTION_SQL if c not in ("weak", "has_capability")]
CERT_FIELDS = ("c_subject", "c_issuer", "c_serial", "c_not_after", "c_self", "c_label", "c_ca", "c_days")

CERT_CTE = f"""
kb AS (SELECT * FROM {values_sql(kb.kb_rows(), kb.KB_COLUMNS)}),
libs AS (SELECT * FROM {values_sql(lib.lib_rows(), lib.LIB_COLUMNS)}),
certs0 AS (
  SELECT {_cert_columns(dt.LEAF_SQL)} FROM orders UNION ALL
  SELECT {_cert_columns(dt.AUTHORITY_SQL)} FROM nation UNION ALL
  SELECT {_cert_columns(dt.ROOT_SQL)} FROM region),
certs AS (
  SELECT *, {cmap('sig_oid', {k: v[0] for k, v in SIGNATURE_OIDS.items() if v[0]})} AS sig_hash,
    {cmap('sig_oid', {k: v[1] for k, v in SIGNATURE_OIDS.items()})} AS sig_algorithm,
    {cmap('sig_oid', {k: v[2] for k, v in SIGNATURE_OIDS.items()})} AS sig_label,
    {cmap('pubkey_oid', PUBLIC_KEY_OIDS)} AS pubkey,
    CAST(floor((epoch(not_after) - epoch({AS_OF})) / 86400) AS INT) AS days
  FROM certs0),
cert_d AS (
  SELECT file, 0 AS det_rank, 0 AS ord, 0 AS sub, pubkey AS algorithm,
    CASE WHEN pubkey IN {inlist(AGREEMENT)} THEN 'key-establishment' WHEN is_ca OR usage = 'keyCertSign' THEN 'certificate-validation'
      WHEN usage IN ('keyEncipherment', 'dataEncipherment') THEN 'key-transport' WHEN usage = 'keyAgreement' THEN 'key-establishment'
      ELSE 'digital-signature' END AS role,
    coalesce(key_size, CASE WHEN pubkey IN ('ed25519', 'x25519') THEN 256 WHEN pubkey IN ('ed448', 'x448') THEN 448
      WHEN pubkey = 'ecdsa' THEN {cmap(cmap('curve', CURVES), EC_KEY_BITS)} END) AS key_size,
    curve, pubkey || ' subject public key' AS matched, 'subject-public-key' AS cert_component, pubkey_oid AS oid,
    subject, issuer, serial, not_after, self_signed, sig_label, is_ca, days
  FROM certs WHERE pubkey IS NOT NULL
  UNION ALL
  SELECT file, 0, 0, 1, coalesce(sig_hash, sig_algorithm), 'signature-verification', NULL, NULL,
    coalesce(sig_label, sig_hash, sig_algorithm), 'signature-algorithm', sig_oid,
    subject, issuer, serial, not_after, self_signed, sig_label, is_ca, days
  FROM certs WHERE coalesce(sig_hash, sig_algorithm) IS NOT NULL)"""

LINE_COLUMNS = ", ".join(f"{e} AS {n}" for n, e in dt.DETECTION_SQL.items())
DETS_CTE = CERT_CTE + f""",
line_d AS (
  SELECT {LINE_COLUMNS}, lib_pqc, lib_since
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN kb ON l_partkey % 48 = kb_ord
  LEFT JOIN libs ON CAST(substr(p_brand, 7) AS INT) - 1 = lib_ord),
dets AS (
  SELECT {', '.join(DET_COLUMNS)},
    CASE WHEN has_capability THEN {capability('library_version')} END AS cap, weak, NULL AS cert_component, NULL AS oid,
    {', '.join(f'NULL AS {c}' for c in CERT_FIELDS)}, false AS is_cert
  FROM line_d
  UNION ALL BY NAME
  SELECT file, det_rank, ord, sub, 'certificate-x509' AS detector, 'x509-parse' AS method, 'high' AS confidence, algorithm, role,
    key_size, curve, 'x509' AS language, matched, cert_component, oid, subject AS c_subject, issuer AS c_issuer, serial AS c_serial,
    not_after AS c_not_after, self_signed AS c_self, sig_label AS c_label, is_ca AS c_ca, days AS c_days, true AS is_cert
  FROM cert_d)"""

EVIDENCE = cmap("method", pol.METHOD_EVIDENCE)
ATTR_CTE = DETS_CTE + f""",
repos AS (
  SELECT 'app-' || s_nationkey AS app, 'repo-' || s_suppkey AS repo FROM supplier
  UNION ALL SELECT 'app-' || ((s_nationkey + 1) % 25), 'repo-' || s_suppkey || '/src' FROM supplier WHERE s_suppkey % 5 = 0),
conts AS (SELECT 'app-' || s_nationkey AS app, 'ctr-' || s_suppkey AS cont FROM supplier WHERE s_suppkey % 10 <> 0),
files AS (SELECT DISTINCT file FROM dets),
file_cut AS (SELECT file, string_split(file, '/') AS parts FROM files),
file_up AS (SELECT file, array_to_string(parts[1:i], '/') AS prefix FROM (SELECT file, parts, unnest(range(1, len(parts) + 1)) AS i FROM file_cut)),
file_repo AS (
  SELECT file, arg_max(repo, length(repo)) AS repository, arg_max(app, length(repo)) AS app
  FROM file_up JOIN repos ON prefix = repo GROUP BY file),
att AS (
  SELECT d.*, r.repository, coalesce(r.app, c.app) AS application, {EVIDENCE} AS evidence_type,
    CASE d.confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS cr,
    CASE WHEN d.method IN ('ast-call', 'x509-parse') THEN 0 ELSE 1 END AS prim,
    kb_identity
  FROM dets d LEFT JOIN file_repo r ON d.file = r.file LEFT JOIN conts c ON d.container = c.cont LEFT JOIN kb ON d.algorithm = kb_id),
keyed AS (
  SELECT *, evidence_type IN {inlist(DEMONSTRATES_USE)} OR (evidence_type = 'source-lexical' AND confidence = 'high') AS proves,
    CASE WHEN is_cert THEN {key('cert', 'c_serial', 'cert_component', 'algorithm', 'application')}
      WHEN detector IN ('dependency-manifest', 'container') THEN {key('lib', 'library', 'library_version', 'package', 'image', 'application', 'file')}
      WHEN detector = 'binary-format' THEN {key('bin', 'file', 'kb_identity', 'library', 'method', 'protocol', 'protocol_version')}
      WHEN algorithm IS NULL AND protocol IS NOT NULL THEN {key('proto', 'protocol', 'protocol_version', 'file', 'line', 'application')}
      ELSE {key('src', 'file', 'line', 'kb_identity', 'application')} END AS gkey
  FROM att)"""

MERGED = ("algorithm", "curve", "mode", "padding", "protocol", "protocol_version", "library", "library_version", "package")
PRIMARY = ("file", "line", "language", "detector", "method", "matched", "protocol", "library", "algorithm", "repository",
           "application", "container", "image", "oid", "cert_component", "is_cert", *CERT_FIELDS)
ASSETS_CTE = ATTR_CTE + f""",
merged AS (
  SELECT gkey, {', '.join(f"{first(m, f'{m} IS NOT NULL')} AS {m}" for m in MERGED)},
    {first('key_size', 'key_size IS NOT NULL')} AS key_size,
    {first('role', "role IS NOT NULL AND role <> 'unknown'")} AS m_role,
    {', '.join(f"{first(p)} AS p_{p}" for p in PRIMARY)},
    bool_or(evidence_type IN {inlist(CAN_ESTABLISH_ROLE)}) AS role_ok,
    last(cap ORDER BY {ORDER}) FILTER (WHERE cap IS NOT NULL) AS pqc_readiness,
    bool_or(coalesce(in_test_path, false)) AS t_test, bool_or(coalesce(suspected_non_security_use, false)) AS t_non,
    bool_or(coalesce(key_size_assumed, false)) AS t_assumed, bool_or(coalesce(hybrid_non_nist, false)) AS t_nonnist,
    bool_or(coalesce(key_material_in_image, false)) AS t_key,
    bool_or(coalesce(crypto_agility_blocker, false) OR coalesce(floating_tag, false)) AS t_blocker,
    bool_or(coalesce(weak, false)) AS t_weak,
    list(DISTINCT 'evidence-' || evidence_tier) FILTER (WHERE evidence_tier IS NOT NULL) AS t_tiers,
    first(evidence_type ORDER BY cr DESC, CASE WHEN proves THEN 0 ELSE 1 END, prim, file, det_rank, ord, sub) FILTER (WHERE evidence_type IS NOT NULL) AS evidence_type,
    bool_or(proves) AS proves_use, max(cr) AS cr, count(*) AS duplicate_count,
    array_to_string(list_sort(list(DISTINCT detector)), ',') AS detectors,
    min((file, det_rank, ord, sub)) AS asset_seq
  FROM keyed GROUP BY gkey),
typed AS (
  SELECT m.*, kb.*, libs.*,
    CASE WHEN p_is_cert THEN 'certificate' WHEN p_detector = 'container' THEN 'container-package' WHEN p_detector = 'binary-format' THEN 'binary-artifact'
      WHEN p_detector = 'dependency-manifest' THEN 'dependency' WHEN p_algorithm IS NULL AND p_protocol IS NOT NULL THEN 'protocol-config'
      WHEN p_algorithm IS NULL AND p_library IS NOT NULL THEN 'library' ELSE 'source-finding' END AS asset_type,
    {BITS} AS security_strength
  FROM merged m LEFT JOIN kb ON algorithm = kb_id LEFT JOIN libs ON library = lib_id),
facts AS (
  SELECT *,
    'ca-' || substr(sha256(concat_ws('|', coalesce(p_application, ''), coalesce(p_file, ''), coalesce(CAST(p_line AS VARCHAR), ''), coalesce(algorithm, ''),
      coalesce(protocol, ''), coalesce(protocol_version, ''), coalesce(library, ''), coalesce(library_version, ''), coalesce(p_c_serial, ''),
      coalesce(p_cert_component, ''), coalesce(p_image, ''), CASE WHEN asset_type = 'binary-artifact' THEN coalesce(p_method, '') ELSE '' END)), 1, 16) AS asset_id,
    CASE WHEN kb_name IS NOT NULL THEN concat_ws('-', kb_name,
        CASE WHEN key_size <> 0 AND kb_family IN ('RSA', 'DSA', 'DH') THEN CAST(key_size AS VARCHAR) END,
        CASE WHEN kb_family = 'EC' THEN curve END,
        CASE WHEN kb_primitive IN ('block-cipher', 'ae', 'stream-cipher') THEN upper(mode) END)
      WHEN protocol <> '' THEN protocol || ' ' || coalesce(protocol_version, 'None')
      WHEN library <> '' THEN concat_ws(' ', coalesce(lib_name, library), library_version)
      ELSE coalesce(p_matched, 'cryptographic artefact') END AS asset_name,
    CASE WHEN kb_class IS NULL THEN NULL WHEN kb_class IN ('shor_broken', 'classically_broken') THEN 0 WHEN kb_primitive = 'hash' THEN security_strength
      WHEN kb_class = 'grover_reduced' THEN CASE WHEN security_strength <> 0 THEN security_strength // 2 END ELSE kb_bits END AS quantum_strength,
    coalesce(m_role, CASE WHEN role_ok THEN kb_default_role END, 'unknown') AS cryptographic_role,
    coalesce(kb_class, 'unknown') AS quantum_class, coalesce(kb_class = 'shor_broken', false) AS quantum_vulnerable,
    CASE cr WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
    list_sort(list_concat(list_filter([CASE WHEN p_c_ca THEN 'certificate-authority' END, CASE WHEN p_c_self THEN 'self-signed' END,
      CASE WHEN t_non THEN 'suspected-non-security-use' END, CASE WHEN t_test THEN 'test-path' END, CASE WHEN t_assumed THEN 'key-size-assumed' END,
      CASE WHEN t_key THEN 'key-material-exposure' END, CASE WHEN t_blocker THEN 'crypto-agility-blocker' END,
      CASE WHEN t_nonnist THEN 'hybrid-non-nist' END, CASE WHEN t_weak THEN 'weak-cipher-suite' END,
      CASE WHEN NOT coalesce(proves_use, false) THEN 'presence-only-evidence' END], lambda x: x IS NOT NULL), coalesce(t_tiers, []))) AS tags
  FROM typed),
apps AS (SELECT {', '.join(f'{e} AS {n}' for n, e in dt.APPLICATION_SQL.items())},
  CASE WHEN n_nationkey % 2 = 0 THEN 'PCI' ELSE 'GDPR; PCI' END AS regulatory FROM nation JOIN region ON n_regionkey = r_regionkey),
cert_bind AS (SELECT 'o' || o_orderkey || '.crt' AS base, 'app-' || c_nationkey AS app FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'),
bin_bind AS (SELECT 'tool-' || s_suppkey || '-' || m || '.bin' AS base, 'app-' || s_nationkey AS app
  FROM supplier CROSS JOIN (SELECT unnest(range(12)) AS m) WHERE s_suppkey % 2 = 0),
assets AS (
  SELECT f.*, a.app_id AS application, a.owner, a.business_unit, a.data_classification, a.data_lifetime_years, a.criticality AS business_criticality,
    a.exposure, coalesce(a.exposure IN ('external-facing', 'internet-facing-critical'), false) AS internet_exposed,
    CASE WHEN a.app_id IS NOT NULL THEN CASE WHEN a.description <> '' THEN a.description ELSE a.name END END AS usage,
    coalesce(a.context_source, 'default') AS context_source, coalesce(a.regulatory, '') AS regulatory
  FROM facts f
  LEFT JOIN cert_bind cb ON f.p_application IS NULL AND split_part(f.p_file, '/', -1) = cb.base
  LEFT JOIN bin_bind bb ON f.p_application IS NULL AND split_part(f.p_file, '/', -1) = bb.base
  LEFT JOIN apps a ON coalesce(f.p_application, cb.app, bb.app) = a.app_id)"""


def round_tenth(x: str) -> str:
    """One decimal, half to even on the exact binary value."""
    a, b = f"({x} * 16.0::DOUBLE)", f"({x} * 4.0::DOUBLE)"
    s = f"({a} + {b})"
    err = f"({b} - ({s} - {a}))"
    return (f"(CASE WHEN {s} % 2.0 = 1.0 AND {err} > 0 THEN ceil({s} / 2.0) WHEN {s} % 2.0 = 1.0 AND {err} < 0 THEN floor({s} / 2.0) "
            f"ELSE round_even({s} / 2.0, 0) END / 10.0)")


def axes(floor_sym="128", floor_hash="128", floor_pk="112", source="assets", names="") -> str:
    """Columns of both axes given the policy floors."""
    ver = "trim(coalesce(protocol_version, ''))"
    only = "(kb_name IS NULL AND coalesce(protocol <> '', false))"
    floor = f"CASE WHEN kb_primitive IN ('hash', 'mac') THEN {floor_hash} WHEN kb_primitive IN ('block-cipher', 'stream-cipher', 'ae') THEN {floor_sym} ELSE {floor_pk} END"
    return f"""
    CASE WHEN p_c_days < 0 THEN 'critical' WHEN p_c_days < 30 THEN 'high' WHEN lower(p_c_label) LIKE '%sha1%' THEN 'critical'
      WHEN t_weak THEN 'high'
      WHEN {only} THEN CASE WHEN upper(protocol) = 'SSL' OR {ver} IN ('2.0', '3.0') THEN 'critical' WHEN {ver} IN ('1.0', '1.1') THEN 'high'
        WHEN {ver} = '1.2' THEN 'low' WHEN {ver} = '1.3' THEN 'info' ELSE 'low' END
      WHEN kb_name IS NULL THEN 'info' WHEN kb_status = 'broken' THEN 'critical' WHEN kb_class = 'classically_broken' THEN 'high'
      WHEN security_strength < 80 THEN 'critical' WHEN security_strength < 112 THEN 'high' WHEN security_strength < 128 THEN 'medium'
      WHEN security_strength < {floor} THEN 'medium' WHEN security_strength < 192 THEN 'low' WHEN security_strength IS NOT NULL THEN 'info' ELSE 'low' END AS classical_risk,
    CASE WHEN p_c_days < 0 THEN 'expired-certificate' WHEN p_c_days < 30 THEN 'expiring-certificate' WHEN lower(p_c_label) LIKE '%sha1%' THEN 'sha1-signature'
      WHEN t_weak THEN 'weak-cipher-suite'
      WHEN {only} THEN CASE WHEN upper(protocol) = 'SSL' OR {ver} IN ('2.0', '3.0') THEN 'prohibited-protocol' WHEN {ver} IN ('1.0', '1.1') THEN 'deprecated-protocol'
        WHEN {ver} IN ('1.2', '1.3') THEN 'current-protocol' ELSE 'protocol-unreviewed' END
      WHEN kb_name IS NULL THEN 'unresolved' WHEN kb_status = 'broken' THEN 'broken-primitive' WHEN kb_class = 'classically_broken' THEN 'deprecated-primitive'
      WHEN security_strength IS NOT NULL THEN 'parameter-strength' ELSE 'indeterminate' END AS classical_trigger,
    CASE WHEN kb_name IS NULL THEN CASE WHEN protocol = 'TLS' AND protocol_version IN ('1.0', '1.1', '1.2') THEN 'medium'
        WHEN protocol = 'TLS' AND protocol_version = '1.3' THEN 'low' ELSE 'info' END
      WHEN kb_class = 'shor_broken' THEN 'critical'
      WHEN kb_class = 'grover_reduced' AND kb_primitive = 'hash' THEN CASE WHEN coalesce(security_strength, 0) >= {floor_hash} THEN 'info' ELSE 'low' END
      WHEN kb_class = 'grover_reduced' THEN CASE WHEN quantum_strength < 96 THEN 'medium' ELSE 'info' END
      WHEN kb_class IN ('classically_broken', 'pqc_standardized') THEN 'info' WHEN kb_class = 'pqc_selected' THEN 'low'
      WHEN kb_class = 'hybrid_pqt' AND kb_status = 'deprecated' THEN 'medium' WHEN kb_class = 'hybrid_pqt' THEN 'info' ELSE 'low' END AS quantum_exposure,
    CASE WHEN kb_name IS NULL THEN CASE WHEN protocol = 'TLS' AND protocol_version IN ('1.0', '1.1', '1.2') THEN 'protocol-blocks-pqc'
        WHEN protocol = 'TLS' AND protocol_version = '1.3' THEN 'protocol-pqc-capable' ELSE 'unresolved' END
      WHEN kb_class = 'shor_broken' THEN 'shor-vulnerable' WHEN kb_class = 'grover_reduced' AND kb_primitive = 'hash' THEN 'grover-hash'
      WHEN kb_class = 'grover_reduced' THEN CASE WHEN quantum_strength < 96 THEN 'grover-margin-low' ELSE 'grover-adequate' END
      WHEN kb_class = 'classically_broken' THEN 'classical-not-quantum' WHEN kb_class = 'pqc_standardized' THEN 'already-migrated'
      WHEN kb_class = 'pqc_selected' THEN 'pqc-not-final' WHEN kb_status = 'deprecated' THEN 'draft-hybrid' ELSE 'hybrid-target-state' END AS quantum_trigger,
    CASE WHEN kb_class = 'shor_broken' THEN CASE WHEN cryptographic_role IN ('key-establishment', 'key-transport') AND coalesce(data_lifetime_years, 0) >= 5 THEN true
      WHEN cryptographic_role IN ('digital-signature', 'signature-verification', 'authentication', 'certificate-validation') THEN false END END AS harvest_now"""


VER = "trim(coalesce(protocol_version, ''))"
RISK_CTE = ASSETS_CTE + f""",
axis AS (SELECT *, {axes()},
    CASE WHEN kb_name IS NULL AND coalesce(protocol, '') = '' THEN 25.0
      WHEN kb_name IS NULL THEN CASE WHEN upper(protocol) = 'SSL' OR {VER} IN ('2.0', '3.0') THEN 95.0 WHEN {VER} IN ('1.0', '1.1') THEN 82.0
        WHEN {VER} = '1.2' THEN 55.0 WHEN {VER} = '1.3' THEN 18.0 ELSE 40.0 END
      WHEN kb_class = 'shor_broken' THEN 100.0 WHEN kb_class = 'classically_broken' THEN CASE WHEN kb_status = 'broken' THEN 95.0 ELSE 80.0 END
      WHEN kb_class = 'grover_reduced' THEN CASE WHEN security_strength < 112 THEN 70.0 WHEN quantum_strength < 96 THEN 35.0 ELSE 10.0 END
      WHEN kb_class = 'pqc_standardized' THEN 3.0 WHEN kb_class = 'pqc_selected' THEN 30.0
      WHEN kb_class = 'hybrid_pqt' THEN CASE WHEN kb_status = 'deprecated' THEN 45.0 ELSE 2.0 END ELSE 30.0 END::DOUBLE AS exposure_raw,
    (2.0 + CASE WHEN asset_type = 'certificate' THEN 1.0 ELSE 0 END + CASE WHEN asset_type = 'binary-artifact' THEN 1.5 ELSE 0 END
      + CASE WHEN protocol = 'TLS' AND protocol_version IN ('1.0', '1.1', '1.2') THEN 1.0 ELSE 0 END
      + CASE pqc_readiness WHEN 'none' THEN 1.5 WHEN 'provider' THEN 0.5 WHEN 'native' THEN -0.5 ELSE 0 END
      + CASE WHEN p_language IN ('java', 'kotlin', 'scala', 'c', 'cpp') THEN 0.5 ELSE 0 END
      + CASE WHEN t_blocker THEN 1.0 ELSE 0 END + CASE WHEN t_key THEN 0.5 ELSE 0 END
      + CASE WHEN business_criticality IN ('mission-critical', 'high') THEN 0.5 ELSE 0 END)::DOUBLE AS effort_points
  FROM assets),
effort AS (SELECT *, CASE WHEN effort_points <= 2.0 THEN 'trivial' WHEN effort_points <= 2.8 THEN 'low' WHEN effort_points <= 3.8 THEN 'moderate'
    WHEN effort_points <= 4.8 THEN 'high' ELSE 'very-high' END AS migration_effort FROM axis),
raws AS (SELECT *, least(coalesce(data_lifetime_years, 3), 20) / 20.0::DOUBLE * 100.0::DOUBLE AS life_raw,
    ({cmap("coalesce(data_classification, 'internal')", pol.CLASSIFICATION)} - 1) / 4.0::DOUBLE * 100.0::DOUBLE AS sens_raw,
    {cmap("coalesce(exposure, 'internal')", pol.EXPOSURE)} / 4.0::DOUBLE * 100.0::DOUBLE AS exp_raw,
    ({cmap("coalesce(business_criticality, 'important')", pol.CRITICALITY)} - 1) / 4.0::DOUBLE * 100.0::DOUBLE AS crit_raw,
    ({cmap('migration_effort', pol.EFFORT)} - 1) / 4.0::DOUBLE * 100.0::DOUBLE AS effort_raw,
    {cmap('migration_effort', pol.EFFORT_MONTHS)} AS migration_months FROM effort),
scored AS (SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE,
    (((((0.0::DOUBLE + exposure_raw * 0.3::DOUBLE) + life_raw * 0.2::DOUBLE) + sens_raw * 0.18::DOUBLE) + exp_raw * 0.14::DOUBLE) + crit_raw * 0.12::DOUBLE + effort_raw * 0.06::DOUBLE)
    * (CASE cr WHEN 2 THEN 1.0 WHEN 1 THEN 0.92 ELSE 0.78 END)::DOUBLE
    * (CASE WHEN t_non THEN 0.55 ELSE 1.0 END)::DOUBLE * (CASE WHEN t_test THEN 0.7 ELSE 1.0 END)::DOUBLE)) AS exact FROM raws),
rounded AS (SELECT *, {round_tenth('exact')} AS risk_score,
    CASE WHEN exact >= 80 THEN 'critical' WHEN exact >= 60 THEN 'high' WHEN exact >= 40 THEN 'medium' WHEN exact >= 20 THEN 'low' ELSE 'info' END AS risk_band,
    CASE WHEN kb_name IS NULL THEN 'unknown' WHEN kb_status = 'broken' THEN 'broken' WHEN security_strength IS NULL THEN 'unknown'
      WHEN security_strength < 80 THEN 'broken' WHEN security_strength < 112 THEN 'weak' WHEN security_strength < 128 THEN 'legacy'
      WHEN security_strength < 192 THEN 'acceptable' ELSE 'strong' END AS classical_security_status,
    (0.0 + CASE asset_type WHEN 'binary-artifact' THEN 2.5 WHEN 'protocol-config' THEN -2.0 WHEN 'certificate' THEN 1.0 WHEN 'dependency' THEN -0.5
        WHEN 'container-package' THEN -0.5 WHEN 'source-finding' THEN 0.5 ELSE 0 END
      + CASE WHEN asset_type = 'source-finding' AND evidence_type = 'source-api' THEN 0.5 ELSE 0 END
      + CASE WHEN protocol = 'TLS' AND protocol_version = '1.3' THEN -1.5 WHEN protocol = 'TLS' AND protocol_version IN ('1.0', '1.1', '1.2') THEN 1.0
          WHEN protocol IN ('SSH', 'IKE') THEN -1.0 ELSE 0 END
      + CASE pqc_readiness WHEN 'native' THEN -1.5 WHEN 'provider' THEN 0.5 WHEN 'none' THEN 2.0 ELSE 0 END
      + CASE WHEN t_blocker THEN 1.5 ELSE 0 END + CASE WHEN t_key THEN 1.0 ELSE 0 END
      + CASE WHEN p_language IN ('c', 'cpp') THEN 0.75 WHEN p_language IN ('java', 'kotlin', 'scala') THEN 0.25 WHEN p_language = 'config' THEN -1.0 ELSE 0 END)::DOUBLE AS agility_points
  FROM scored),
risk AS (SELECT *, CASE WHEN agility_points <= -1.5 THEN 'high' WHEN agility_points <= 1.5 THEN 'medium' ELSE 'low' END AS crypto_agility,
    CASE WHEN asset_type = 'certificate' OR cryptographic_role = 'certificate-validation' OR asset_type = 'binary-artifact' THEN 'constrained'
      WHEN protocol IN ('TLS', 'SSH', 'IKE') OR internet_exposed OR cryptographic_role = 'signature-verification' THEN 'negotiated' ELSE 'open' END AS interoperability
  FROM rounded)"""

NOW_YEAR = f"(year({AS_OF})::DOUBLE + (dayofyear({AS_OF}) - 1) / 365.25::DOUBLE)"


def urgency_columns(year: str = "2035", source: str = "risk") -> str:
    x, y = "coalesce(data_lifetime_years, 3)::DOUBLE", "(migration_months / 12.0::DOUBLE)"
    gap = f"(({x} + {y} + 1.0::DOUBLE) - ({year}::DOUBLE - {NOW_YEAR}))"
    start = f"({year}::DOUBLE - {x} - {y} - 1.0::DOUBLE)"
    until = f"({start} - {NOW_YEAR})"
    return f"""CASE WHEN NOT quantum_vulnerable THEN 'not-applicable' WHEN {gap} > 0 AND {until} < -2 THEN 'already-late' WHEN {gap} > 0 THEN 'critical'
      WHEN {until} <= 2 THEN 'urgent' WHEN {until} <= 5 THEN 'plan-now' ELSE 'monitor' END AS mosca_urgency,
    CASE WHEN quantum_vulnerable THEN round_even({gap} * 100.0::DOUBLE, 0) / 100.0 ELSE 0.0 END::DOUBLE AS mosca_gap_years,
    CASE WHEN quantum_vulnerable THEN round_even({start} * 10.0::DOUBLE, 0) / 10.0 ELSE {year} END::DOUBLE AS latest_start_year"""


MULT = cmap("mosca_urgency", pol.URGENCY_MULTIPLIER)
PRIORITY = f"""least(100.0::DOUBLE, risk_score * ({MULT})::DOUBLE)"""
BAND = (f"CASE WHEN {PRIORITY} >= 78 THEN 'P0' WHEN {PRIORITY} >= 58 OR quantum_class = 'classically_broken' THEN 'P1' "
        f"WHEN {PRIORITY} >= 38 THEN 'P2' ELSE 'P3' END")
URGENCY_CTE = RISK_CTE + f""",
urgent0 AS (SELECT *, {urgency_columns()} FROM risk),
urgent AS (SELECT *, CAST(round_even({PRIORITY}, 0) AS INT) AS migration_priority, {BAND} AS priority_band FROM urgent0)"""

FAMILY = cmap("cryptographic_role", kb.ROLE_FAMILY, "'unknown'")
TIER = ("CASE WHEN coalesce(nullif(security_strength, 0), 128) >= 256 THEN 256 "
        "WHEN coalesce(nullif(security_strength, 0), 128) >= 192 THEN 192 ELSE 128 END")
OLD = "protocol = 'TLS' AND protocol_version IN ('1.0', '1.1', '1.2')"
PROVIDER_CAP = capability("library_version")
FLOOR = "CASE WHEN kb_first_role IN ('hashing', 'message-authentication') THEN 128 ELSE 128 END"
HAS_LIB = "coalesce(library <> '', false)"
DECIDE_CTE = URGENCY_CTE + f""",
targets AS (SELECT * FROM {values_sql(pol.TARGETS, pol.TARGET_COLUMNS)}),
fam AS (SELECT *, {FAMILY} AS fam, regexp_matches(lower(concat_ws(' ', p_file, application, usage, asset_name)), '{"|".join(pol.FIRMWARE_WORDS)}') AS firmware, {TIER} AS tier FROM urgent),
tgt AS (SELECT * FROM fam LEFT JOIN targets ON t_tier = tier AND t_family = CASE WHEN fam = 'signature' AND firmware THEN 'firmware-signature' ELSE fam END),
ruled AS (SELECT *, CASE
    WHEN t_key THEN 'exposed-key'
    WHEN kb_name IS NULL AND protocol <> '' THEN CASE WHEN protocol = 'SSL' OR (protocol = 'TLS' AND protocol_version IN ('1.0', '1.1')) THEN 'legacy-protocol'
      WHEN protocol = 'TLS' AND protocol_version = '1.2' THEN 'tls12' WHEN protocol = 'TLS' AND protocol_version = '1.3' THEN 'tls13' ELSE 'other-protocol' END
    WHEN kb_name IS NULL AND {HAS_LIB} THEN CASE {PROVIDER_CAP} WHEN 'native' THEN 'native-provider' WHEN 'none' THEN 'provider-without-path' ELSE 'provider-unconfirmed' END
    WHEN kb_name IS NULL THEN 'unresolved'
    WHEN p_c_days < 0 THEN 'expired'
    WHEN kb_class = 'classically_broken' THEN 'classically-broken'
    WHEN kb_class = 'pqc_standardized' THEN 'post-quantum'
    WHEN kb_class = 'hybrid_pqt' THEN CASE WHEN kb_status = 'deprecated' THEN 'draft-hybrid' ELSE 'hybrid' END
    WHEN kb_class = 'pqc_selected' THEN 'not-final'
    WHEN kb_class = 'grover_reduced' THEN CASE WHEN security_strength < {FLOOR} THEN 'below-floor' ELSE 'meets-floor' END
    WHEN cryptographic_role = 'unknown' THEN 'role-unknown'
    WHEN fam IN ('hash', 'kdf') THEN 'role-mismatch'
    WHEN kb_family = 'RSA' AND cryptographic_role IN ('key-transport', 'encryption') THEN 'rsa-transport'
    WHEN t_primary IS NULL THEN 'no-target' WHEN fam = 'signature' THEN 'signature' ELSE 'key-establishment' END AS rule FROM tgt),
acted AS (SELECT *, CASE rule WHEN 'exposed-key' THEN 'rotate-and-externalise-key' WHEN 'legacy-protocol' THEN 'upgrade-protocol' WHEN 'tls12' THEN 'upgrade-protocol'
    WHEN 'tls13' THEN 'migrate-to-pqt-hybrid' WHEN 'native-provider' THEN 'retain' WHEN 'provider-without-path' THEN 'migrate-to-pqc'
    WHEN 'expired' THEN 'renew-certificate' WHEN 'classically-broken' THEN 'replace-now-classical' WHEN 'post-quantum' THEN 'retain' WHEN 'hybrid' THEN 'retain'
    WHEN 'draft-hybrid' THEN 're-pin-to-standard' WHEN 'meets-floor' THEN 'retain' WHEN 'below-floor' THEN 'strengthen-parameters'
    WHEN 'role-unknown' THEN 'determine-role-then-migrate' WHEN 'rsa-transport' THEN 'migrate-to-pqc' WHEN 'signature' THEN 'migrate-to-pqc'
    WHEN 'key-establishment' THEN CASE WHEN t_hybrid IS NOT NULL AND (protocol IS NULL OR protocol = 'TLS') THEN 'migrate-to-pqt-hybrid' ELSE 'migrate-to-pqc' END
    ELSE 'verify-manually' END AS recommended_action FROM ruled),
ctxd AS (SELECT *, {cmap('recommended_action', pol.STRATEGY_DECISION)} AS mapped,
    CASE WHEN fam = 'signature' OR interoperability = 'open' THEN 'PQC-ONLY' ELSE 'HYBRID' END AS ctx FROM acted),
final AS (SELECT *,
    CASE WHEN mapped NOT IN ('HYBRID', 'PQC-ONLY') THEN mapped WHEN algorithm IS NULL AND {HAS_LIB} THEN 'UPGRADE'
      WHEN recommended_action = 're-pin-to-standard' THEN 'HYBRID' ELSE ctx END AS migration_decision,
    CASE WHEN recommended_action IN ('migrate-to-pqt-hybrid', 'migrate-to-pqc') AND NOT (algorithm IS NULL AND {HAS_LIB})
      THEN CASE WHEN ctx = 'HYBRID' THEN 'migrate-to-pqt-hybrid' ELSE 'migrate-to-pqc' END ELSE recommended_action END AS recommended_strategy,
    CASE WHEN rule IN ('not-final', 'rsa-transport') THEN 'ML-KEM-768' WHEN rule IN ('key-establishment', 'signature') THEN t_primary END AS pqc0,
    CASE WHEN rule IN ('legacy-protocol', 'tls12', 'tls13', 'draft-hybrid') OR (rule = 'rsa-transport' AND protocol = 'TLS') THEN 'X25519MLKEM768'
      WHEN rule IN ('key-establishment', 'signature') AND recommended_action = 'migrate-to-pqt-hybrid' THEN t_hybrid END AS hybrid0 FROM ctxd),
decided AS (SELECT *, CASE WHEN migration_decision <> 'RETAIN' THEN pqc0 END AS recommended_pqc,
    CASE WHEN migration_decision IN ('RETAIN', 'PQC-ONLY') THEN NULL WHEN migration_decision = 'HYBRID' THEN coalesce(hybrid0, t_hybrid) ELSE hybrid0 END AS recommended_hybrid,
    CASE WHEN recommended_strategy = 'determine-role-then-migrate' THEN 'role-determination' END AS decision_blocked_on FROM final)"""


def query(level: str, body: str) -> str:
    return f"WITH RECURSIVE {level.strip()} {body}"

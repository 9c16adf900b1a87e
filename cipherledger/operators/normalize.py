"""Detections to canonical assets: attribution, group-merge and business context."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (basename, case, compact, lookup, present, redact,
                                 spread_nulls, stable_id)
from ..functions.strength import classical_bits, quantum_bits
from ..knowledge import algorithms as kb
from ..knowledge import libraries as lib
from ..knowledge import policy as pol
from ..knowledge.tables import dimension

DEMONSTRATES_USE = ("source-api", "config-directive", "certificate", "key-material")
CAN_ESTABLISH_ROLE = ("source-api", "config-directive", "certificate", "source-lexical")


def algorithm_dimension(spark) -> DataFrame:
    """Knowledge base rows, one per accepted spelling (fixed rows, broadcast)."""
    by_id = {r[0]: r for r in kb.kb_rows()}
    rows = [(spelling, *by_id[i]) for spelling, i in kb.alias_rows()]
    return dimension(spark, rows, ("kb_key", *kb.KB_COLUMNS))


def with_algorithm(df: DataFrame, column: str = "algorithm") -> DataFrame:
    dim = algorithm_dimension(df.sparkSession)
    return df.join(dim, F.lower(F.col(column)) == F.col("kb_key"), "left").drop("kb_key")


def proves_use(evidence_type: Column, confidence: Column) -> Column:
    """Linkage, symbol, string and package evidence show presence, not use; a lexical
    match counts only at high confidence."""
    return F.coalesce(evidence_type.isin(*DEMONSTRATES_USE) | (
        (evidence_type == "source-lexical") & (confidence == "high")), F.lit(False))


@dataclass
class Derived:
    """Detections that are cheaper to derive again than to store or to shuffle: their wide
    rows come from narrow ones, which are dealt before they widen."""
    detections: DataFrame                        # all rows
    pairs: DataFrame                             # (file, container) of all rows
    local: DataFrame                             # rows without a certificate, dealt by file
    placed: Callable[[DataFrame], DataFrame]     # places -> the other rows with their place
    unit: str                                    # column of the merge key these are dealt by


# --- attribution ----------------------------------------------------------------------
def repository_of_file(detections: DataFrame, repositories: DataFrame) -> DataFrame:
    """file -> (repository, application) by the longest declared prefix.

    Every distinct file is exploded into its ancestor folders, so the prefix match is an
    equi-join on (ancestor = repository) over distinct files, not over detections.
    """
    # A later declaration of the same prefix replaces an earlier one.
    repos = (repositories.groupBy("repository")
             .agg(F.max_by("app_id", "ord").alias("repo_app"))
             .withColumn("prefix", F.regexp_replace("repository", "/+$", "")))
    parts = F.split("file", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)),
                            lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return (detections.select("file").where(present(F.col("file"))).distinct()
            .select("file", F.explode(ancestors).alias("prefix"))
            .join(repos, "prefix")
            .groupBy("file")
            .agg(F.max_by(F.struct("repository", "repo_app"),
                          F.struct(F.length("repository"), "repository")).alias("m"))
            .select("file", "m.repository", "m.repo_app"))


def places(detections: DataFrame, repositories: DataFrame, containers: DataFrame) -> DataFrame:
    """(a_file, a_container, repository, application) of distinct pairs: prefix first, then
    the container name."""
    first_app = (containers.groupBy(F.col("container").alias("c_name"))
                 .agg(F.min_by("app_id", "ord").alias("c_app")))
    pairs = detections.select(F.col("file").alias("a_file"), F.col("container").alias("a_container")).distinct()
    files = repository_of_file(pairs.select(F.col("a_file").alias("file")), repositories).withColumnRenamed("file", "f_file")
    # Only pairs still without an application need the container; other keys spread.
    needs = F.when(F.col("repo_app").isNull(), F.col("a_container"))
    return (pairs.join(files, F.col("a_file") == F.col("f_file"), "left")
            .join(first_app, spread_nulls(needs, F.col("a_file")) == F.col("c_name"), "left")
            .select("a_file", "a_container", "repository",
                    F.coalesce("repo_app", "c_app").alias("application")))


def attribute(detections: DataFrame, repositories: DataFrame,
              containers: DataFrame) -> DataFrame:
    """Add ``repository`` and ``application``: prefix first, then the container name.

    Both lookups run on distinct (file, container) pairs; the detections themselves are
    joined once.
    """
    return _placed(detections, places(detections, repositories, containers).where(
        "repository IS NOT NULL OR application IS NOT NULL"))


def _placed(detections: DataFrame, found: DataFrame) -> DataFrame:
    on = (F.col("file") == F.col("a_file")) & F.col("container").eqNullSafe(F.col("a_container"))
    return detections.join(found, on, "left").drop("a_file", "a_container")


def late_places(found: DataFrame, certificate_bindings: DataFrame, binary_bindings: DataFrame) -> DataFrame:
    """Add ``late_app``, which a file's basename is bound to, to pairs without an
    application. The pairs are distinct and narrow, so no asset is shuffled for it."""
    cert = (certificate_bindings.groupBy(F.col("basename").alias("cb_name"))
            .agg(F.max("app_id").alias("cb_app")))
    binary = (binary_bindings.groupBy(F.col("basename").alias("bb_name"))
              .agg(F.max("app_id").alias("bb_app")))
    # Mapped pairs take no part in the lookup: their keys spread and match nothing.
    key = spread_nulls(F.when(F.col("application").isNull(), basename(F.col("a_file"))), F.col("a_file"))
    bound = found.join(cert, key == F.col("cb_name"), "left").join(binary, key == F.col("bb_name"), "left")
    late = F.when(F.col("application").isNull(), F.coalesce("cb_app", "bb_app"))
    return bound.select(*found.columns, late.alias("late_app"))


def found_places(detections: DataFrame, estate) -> DataFrame:
    """Places of those (file, container) pairs that have any."""
    return late_places(places(detections, estate.repositories, estate.containers),
                       estate.certificate_bindings, estate.binary_bindings).where(
        "repository IS NOT NULL OR application IS NOT NULL OR late_app IS NOT NULL")


def attributed(detections: DataFrame | Derived, estate, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Detections with ``repository``, ``application`` and ``late_app`` in two tables: those
    whose fact lies in one file, dealt by file, and the others.

    A fact is local if its merge key has the file. All of a file meets in one task, as much
    as the file holds, and is merged there without another shuffle.
    """
    whole = isinstance(detections, Derived)
    if found is None:
        found = found_places(detections.pairs if whole else detections, estate)
    local = F.col("certificate").isNull() & F.col("file").isNotNull()
    by_file = found.where("a_file IS NOT NULL").groupBy("a_file").agg(F.collect_list(F.struct(
        "a_container", "repository", "application", "late_app")).alias("places"))
    inside = detections.local if whole else detections.where(local).repartition("file")
    columns = inside.columns
    inside = inside.join(by_file, F.col("file") == F.col("a_file"), "left")
    place = F.get(F.filter("places", lambda p: p["a_container"].eqNullSafe(F.col("container"))), F.lit(0))
    inside = inside.withColumn("place", place).select(*columns, "place.repository", "place.application", "place.late_app")
    return inside, detections.placed(found) if whole else _placed(detections.where(~local), found)


# --- group-merge ----------------------------------------------------------------------
def _key(*parts) -> Column:
    """A tagged key: nulls and empty strings stay different."""
    return F.concat_ws("\u0001", *[
        F.lit(p) if isinstance(p, str)
        else F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("")) for p in parts])


def merge_key() -> Column:
    """Identity of the underlying fact; detector, size, curve and mode are excluded."""
    c = F.col
    ident = F.when(present(c("algorithm")), F.coalesce(c("kb_identity"), c("algorithm")))
    return case(
        (c("certificate").isNotNull(),
         _key("cert", c("certificate.serial"), c("cert_component"), c("algorithm"), c("application"))),
        (c("detector").isin("dependency-manifest", "container"),
         _key("lib", c("library"), c("library_version"), c("package"), c("image"), c("application"), c("file"))),
        (c("detector") == "binary-format",
         _key("bin", c("file"), ident, c("library"), c("method"), c("protocol"), c("protocol_version"))),
        (c("algorithm").isNull() & present(c("protocol")),
         _key("proto", c("protocol"), c("protocol_version"), c("file"), c("line"), c("application"))),
        otherwise=_key("src", c("file"), c("line"), ident, c("application")))


def keyed(detections: DataFrame, local: bool = False) -> DataFrame:
    """Attributed detections with ``gkey``, evidence type and the merge order ``rk``, which
    leaves out the file where a fact has but one."""
    d = with_algorithm(detections)
    conf = lookup(F.col("confidence"), pol.CONFIDENCE_RANK)
    return (d.withColumn("gkey", merge_key())
            .withColumn("evidence_type", lookup(F.col("method"), pol.METHOD_EVIDENCE))
            .withColumn("proves", proves_use(F.col("evidence_type"), F.col("confidence")))
            .withColumn("conf_rank", conf)
            .withColumn("rk", F.struct(
                (F.lit(2) - F.col("conf_rank")).alias("c"),
                F.when(F.col("method").isin("ast-call", "x509-parse"), 0).otherwise(1).alias("p"),
                (F.lit(None).cast("string") if local else F.col("file")).alias("file"),
                "det_rank", "ord", "sub", "line"))
            .drop(*[c for c in d.columns if c.startswith("kb_")]))


PRIMARY = ("file", "line", "language", "detector", "method", "matched", "protocol",
           "library", "algorithm", "repository", "application", "late_app", "container", "image",
           "oid", "cert_component", "key_material_in_repo", "certificate")
MERGED = ("algorithm", "key_size", "curve", "mode", "padding", "protocol",
          "protocol_version", "library", "library_version", "package")
FLAGS = ("in_test_path", "suspected_non_security_use", "key_size_assumed",
         "hybrid_non_nist")


def merge(detections: DataFrame, *local: str, also: dict[str, Column] | None = None, dealt: bool = False) -> DataFrame:
    """One row per fact. Each field independently takes the first non-empty value in
    evidence order, as a partial aggregate, so a hot key never gathers in one task.
    ``local`` names columns of the key that the rows are already dealt by; ``also`` are
    further aggregates, named ``also_``. With ``dealt`` the former stay as ``by_`` columns."""
    def strongest(name: str) -> Column:
        col = F.col(name)
        cond = present(col) if name != "key_size" else col.isNotNull()
        return F.min_by(F.when(cond, col), F.when(cond, F.col("rk"))).alias("m_" + name)

    role = F.when(present(F.col("role")) & (F.col("role") != kb.UNKNOWN), F.col("role"))
    capable = present(F.col("pqc_capability"))
    evidence_order = F.struct((-F.col("conf_rank")).alias("c"),
                              F.when(F.col("proves"), 0).otherwise(1).alias("x"), "rk")
    typed = F.col("evidence_type").isNotNull()
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    merged = detections.groupBy(*[F.col(c).alias("by_" + c) for c in local], "gkey").agg(
        F.min_by(F.struct(*PRIMARY), "rk").alias("p"),
        *[strongest(m) for m in MERGED],
        F.min_by(role, F.when(role.isNotNull(), F.col("rk"))).alias("m_role"),
        flag(F.col("evidence_type").isin(*CAN_ESTABLISH_ROLE)).alias("role_evidence"),
        F.max_by(F.when(capable, F.struct("pqc_capability", "pqc_note")),
                 F.when(capable, F.col("rk"))).alias("pqc"),
        *[flag(F.col(f)).alias("t_" + f) for f in FLAGS],
        flag(F.coalesce(F.col("key_material_in_repo"), F.lit(False))
             | F.coalesce(F.col("key_material_in_image"), F.lit(False))).alias("t_key"),
        flag(F.coalesce(F.col("crypto_agility_blocker"), F.lit(False))
             | F.coalesce(F.col("floating_tag"), F.lit(False))).alias("t_blocker"),
        flag(F.size("weak_suite_tokens") > 0).alias("t_weak"),
        F.collect_set(F.when(present(F.col("evidence_tier")),
                             F.concat(F.lit("evidence-"), "evidence_tier"))).alias("t_tiers"),
        F.min_by(F.when(typed, F.col("evidence_type")),
                 F.when(typed, evidence_order)).alias("evidence_type"),
        F.bool_or("proves").alias("proves_use"),
        F.max("conf_rank").alias("conf_rank"),
        F.count(F.lit(1)).cast("int").alias("duplicate_count"),
        F.array_sort(F.collect_set("detector")).alias("detectors"),
        F.min(F.struct("file", "det_rank", "ord", "sub", "line")).alias("asset_seq"),
        *[c.alias("also_" + n) for n, c in (also or {}).items()])
    return merged if dealt else merged.drop(*["by_" + c for c in local])


def asset_type() -> Column:
    p = F.col
    return case(
        (p("p.certificate").isNotNull() | (p("p.detector") == "certificate-x509"),
         F.when(p("p.key_material_in_repo"), "key-material").otherwise("certificate")),
        (p("p.detector") == "container", "container-package"),
        (p("p.detector") == "binary-format", "binary-artifact"),
        (p("p.detector") == "dependency-manifest", "dependency"),
        (p("p.algorithm").isNull() & p("p.protocol").isNotNull(), "protocol-config"),
        (p("p.algorithm").isNull() & p("p.library").isNotNull(), "library"),
        otherwise="source-finding")


def display_name() -> Column:
    c = F.col
    label = F.concat_ws(
        "-", c("kb_name"),
        F.when(c("key_size").isNotNull() & (c("key_size") != 0)
               & c("kb_family").isin("RSA", "DSA", "DH"), c("key_size").cast("string")),
        F.when(present(c("curve")) & (c("kb_family") == "EC"), c("curve")),
        F.when(present(c("mode")) & c("kb_primitive").isin("block-cipher", "ae", "stream-cipher"),
               F.upper(c("mode"))))
    protocol = F.trim(F.concat(c("protocol"), F.lit(" "), F.coalesce(c("protocol_version"), F.lit("None"))))
    library = F.concat_ws(" ", F.coalesce(c("lib_name"), c("library")),
                          F.when(present(c("library_version")), c("library_version")))
    return case((c("kb_name").isNotNull(), label), (present(c("protocol")), protocol),
                (present(c("library")), library),
                otherwise=F.when(present(c("matched")), c("matched"))
                .otherwise("cryptographic artefact"))


def build_assets(merged: DataFrame) -> DataFrame:
    """Names, types, ids, strengths and tags of merged facts."""
    p = F.col("p")
    kept = [c for c in merged.columns if c.startswith(("by_", "also_"))]
    a = merged.select(
        "gkey", p, *[F.col("m_" + m).alias(m) for m in MERGED], "m_role", "role_evidence",
        p["file"].alias("file"), p["line"].alias("line"), p["language"].alias("language"),
        p["matched"].alias("matched"), p["repository"].alias("repository"),
        p["application"].alias("source_application"), p["late_app"].alias("late_app"),
        F.coalesce(F.when(present(p["container"]), p["container"]), p["image"]).alias("container"),
        asset_type().alias("asset_type"), "pqc", "t_tiers",
        *["t_" + f for f in FLAGS], "t_key", "t_blocker", "t_weak", "evidence_type",
        "proves_use", "conf_rank", "duplicate_count", "detectors", "asset_seq", *kept)
    a = with_algorithm(a)
    libs = dimension(a.sparkSession, lib.lib_rows(), lib.LIB_COLUMNS)
    a = a.join(libs, a.library == libs.lib_id, "left")
    bits = classical_bits(F.col("kb_family"), F.col("kb_bits"), F.col("key_size"), F.col("curve"))
    cert = p["certificate"]
    tags = F.array_sort(F.array_distinct(F.concat(compact(
        (cert["is_ca"], "certificate-authority"), (cert["self_signed"], "self-signed"),
        (F.col("t_suspected_non_security_use"), "suspected-non-security-use"),
        (F.col("t_in_test_path"), "test-path"),
        (F.col("t_key_size_assumed"), "key-size-assumed"),
        (F.col("t_key"), "key-material-exposure"),
        (F.col("t_blocker"), "crypto-agility-blocker"),
        (F.col("t_hybrid_non_nist"), "hybrid-non-nist"),
        (F.col("t_weak"), "weak-cipher-suite"),
        (~F.col("proves_use"), "presence-only-evidence")), F.col("t_tiers"))))
    a = a.withColumn("security_strength", bits)
    return a.select(
        stable_id("ca", F.col("source_application"), F.col("file"), F.col("line"),
                  F.col("algorithm"), F.col("protocol"), F.col("protocol_version"),
                  F.col("library"), F.col("library_version"), cert["serial"],
                  p["cert_component"], p["image"],
                  F.when(F.col("asset_type") == "binary-artifact", p["method"])).alias("asset_id"),
        "gkey", "asset_type", display_name().alias("asset_name"), "source_application", "late_app",
        "repository", "file", "line", "language", "container", "algorithm",
        F.col("kb_name").alias("algorithm_label"), F.col("kb_family").alias("algorithm_family"),
        F.col("kb_primitive").alias("primitive"), F.col("kb_status").alias("algorithm_status"),
        F.col("kb_standard").alias("algorithm_standard"), F.col("kb_category").alias("pqc_category"),
        F.col("kb_first_role").alias("first_role"),
        F.split("kb_functions", " ").alias("crypto_functions"),
        F.coalesce("kb_class", F.lit("unknown")).alias("quantum_class"),
        (F.coalesce("kb_class", F.lit("")) == kb.SHOR).alias("quantum_vulnerable"),
        "mode", "padding", "key_size", "curve", "security_strength",
        quantum_bits(F.col("kb_class"), F.col("kb_primitive"), F.col("security_strength"),
                     F.col("kb_bits")).alias("quantum_strength"),
        F.coalesce("m_role", F.when(F.col("role_evidence"), F.col("kb_default_role")),
                   F.lit(kb.UNKNOWN)).alias("cryptographic_role"),
        "protocol", "protocol_version", "library", "library_version", "lib_name",
        "lib_pqc", "lib_since", "package",
        F.coalesce("kb_oid", p["oid"]).alias("oid"),
        cert["subject"].alias("certificate_subject"), cert["issuer"].alias("certificate_issuer"),
        cert["serial"].alias("certificate_serial"),
        cert["not_before"].alias("certificate_not_before"),
        cert["not_after"].alias("certificate_expiry"),
        cert["self_signed"].alias("certificate_self_signed"), cert["san"].alias("certificate_san"),
        cert["sig_algorithm_label"].alias("certificate_sig_algorithm"),
        cert["days_to_expiry"].alias("days_to_expiry"),
        F.col("pqc.pqc_capability").alias("pqc_readiness"),
        F.col("pqc.pqc_note").alias("pqc_readiness_note"),
        lookup(F.col("conf_rank"), {2: "high", 1: "medium", 0: "low"}).alias("confidence"),
        lookup(F.col("conf_rank"), {2: 100.0, 1: 72.0, 0: 42.0}).alias("confidence_score"),
        "evidence_type", "proves_use", "duplicate_count", "detectors", tags.alias("tags"),
        "asset_seq", *kept)


# --- business context -----------------------------------------------------------------
CONTEXT = ("owner", "business_unit", "data_classification", "data_lifetime_years",
           "criticality", "exposure", "regulatory")


def bind_context(assets: DataFrame, applications: DataFrame) -> DataFrame:
    """Copy the context of the application an asset lies in or its file is bound to."""
    apps = applications.select(
        F.col("app_id").alias("x_app"), F.col("name").alias("x_name"),
        F.col("description").alias("x_description"), F.col("context_source").alias("x_source"),
        *[F.col(c).alias("x_" + c) for c in CONTEXT])
    want = F.coalesce("source_application", "late_app")
    a = assets.join(apps, spread_nulls(want, F.col("gkey")) == F.col("x_app"), "left")
    return a.select(
        *[c for c in assets.columns if c != "late_app"],
        F.coalesce("source_application", F.when(F.col("x_app").isNotNull(), F.col("late_app"))).alias("application"),
        F.col("x_owner").alias("owner"), F.col("x_business_unit").alias("business_unit"),
        F.col("x_data_classification").alias("data_classification"),
        F.col("x_data_lifetime_years").alias("data_lifetime_years"),
        F.col("x_criticality").alias("business_criticality"),
        F.col("x_exposure").alias("exposure"),
        F.coalesce(F.col("x_exposure").isin("external-facing", "internet-facing-critical"),
                   F.lit(False)).alias("internet_exposed"),
        F.when(F.col("x_app").isNotNull(), F.coalesce(
            F.when(present(F.col("x_description")), F.col("x_description")), F.col("x_name"))).alias("usage"),
        F.coalesce("x_regulatory", F.array().cast("array<string>")).alias("compliance_tags"),
        F.coalesce("x_source", F.lit("default")).alias("context_source"),
        F.lit("open").alias("triage_state"))


def normalize_parts(detections: DataFrame | Derived, estate, found: DataFrame | None = None, chains: bool = False) -> list[DataFrame]:
    """Assets of facts inside one file, dealt by ``by_file``, and the others (certificates),
    of derived detections dealt by a column of theirs. ``chains`` adds ``also_chain``."""
    inside, others = attributed(detections, estate, found)
    unit = [detections.unit] if isinstance(detections, Derived) else []
    parts = []
    for rows, by in ((keyed(inside, local=True), ["file"]), (keyed(others), unit)):
        rows, also = first_four(rows, by) if chains else (rows, None)
        parts.append(bind_context(build_assets(merge(rows, *by, also=also, dealt=True)), estate.applications))
    return parts


def whole(parts: list[DataFrame]) -> DataFrame:
    """The parts as one table of assets."""
    return reduce(DataFrame.unionByName, [p.drop(*[c for c in p.columns if c.startswith("by_")]) for p in parts])


def normalize(detections: DataFrame | Derived, estate, found: DataFrame | None = None) -> DataFrame:
    """Detections to assets with business context."""
    return whole(normalize_parts(detections, estate, found))


# --- evidence -------------------------------------------------------------------------
def evidence_rows(detections: DataFrame, estate) -> DataFrame:
    """Keyed detections, as they are merged."""
    inside, others = attributed(detections, estate)
    return keyed(inside, local=True).unionByName(keyed(others))


def evidence_table(detections: DataFrame, assets: DataFrame, estate) -> DataFrame:
    """One row per piece of evidence, redacted; kept long so that a fact seen a billion
    times never becomes one row. Join on the merge key is skew-splittable."""
    location = (F.when(present(F.col("file")) & F.col("line").isNotNull() & (F.col("line") != 0),
                       F.concat_ws(":", "file", F.col("line").cast("string")))
                .when(present(F.col("file")), F.col("file"))
                .otherwise(F.coalesce("container", F.lit("n/a"))))
    return (evidence_rows(detections, estate).select("gkey", "rk", "detector", "method", "evidence_type", "confidence",
                     location.alias("location"),
                     F.when(present(F.col("snippet")), redact(F.col("snippet"))).alias("snippet"),
                     "matched", "reasoning", "proves")
            .join(assets.select("gkey", "asset_id"), "gkey"))


def first_four(rows: DataFrame, by: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Keyed rows, and the aggregate that names the first four of each fact. Rows that are
    dealt by a column of their key are ranked and merged where they lie."""
    n, named = "rank in the fact", F.concat("detector", F.lit("("), "method", F.lit(")"))
    ranked = rows.withColumn(n, F.row_number().over(Window.partitionBy(*by, "gkey").orderBy("rk")))
    return ranked, {"chain": F.concat_ws(" + ", *[F.max(F.when(F.col(n) == i, named)) for i in range(1, 5)])}


def provenance(evidence: DataFrame, assets: DataFrame, key: str = "asset_id") -> DataFrame:
    """asset_id, or another ``key``, -> sentence naming the first four detections. The rank filter is applied
    before the shuffle as well, so only four rows per fact and task travel."""
    w = Window.partitionBy("gkey").orderBy("rk")
    top = (evidence.withColumn("n", F.row_number().over(w)).where("n <= 4")
           .groupBy("gkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
               F.struct("n", F.concat("detector", F.lit("("), "method", F.lit(")")).alias("d")))),
               lambda s: s["d"]), " + ").alias("chain")))
    return told(assets.join(top, "gkey"), "chain", key)


def told(assets: DataFrame, chain: str, key: str = "asset_id") -> DataFrame:
    return assets.select(key, sentence(chain).alias("provenance"))


def sentence(chain: str) -> Column:
    """Text on an asset's first detections, which ``chain`` names."""
    more = F.when(F.col("duplicate_count") > 4, F.concat(
        F.lit(" +"), (F.col("duplicate_count") - 4).cast("string"), F.lit(" more"))).otherwise("")
    tail = (F.when(F.col("proves_use"), "evidence shows the algorithm is reachable")
            .otherwise("presence inferred from linkage, packaging or lexical context only"))
    return F.concat(F.col("duplicate_count").cast("string"), F.lit(" detection(s) via "), chain, more,
                    F.lit("; highest confidence "), "confidence", F.lit("; "), tail)

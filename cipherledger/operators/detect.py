"""Fan-out: every routed file through every detector that applies, in one scan.

The corpus is read once. One row-local projection computes the facts of all detectors for a
file, one explode makes them rows, and they are written once; coverage is counted by the same
scan. Detectors then refine the facts, which are few beside the texts, and their results are
unioned. ``try``-style functions let a malformed file yield no rows instead of an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.columns import basename, extension
from ..functions.text import LANGUAGES, language_of, split_lines
from ..session import write_stage
from . import binaries, callsites, config, containers, keymaterial, lexical, manifests
from .certificates import certificate_detections
from .facts import exploded
from .keymaterial import PARSED
from .manifests import MANIFESTS

#: Detectors over the facts of files.
REFINERS = (keymaterial.refine, binaries.refine, callsites.refine, config.refine, manifests.refine, containers.refine, lexical.refine)
# Reasons of files that are not read; extensions of settings.
SKIP_REASONS = ("ignored-extension", "too-large", "unknown-extension", "binary-content")
CONFIG_EXT = (".conf", ".cnf", ".properties", ".ini")


def file_facts(routed: DataFrame) -> DataFrame:
    """All facts of all files (path, fact, ...), from one scan.

    Certificate-kind files that hold neither a certificate nor a private key, such as public
    keys and requests, go to the text detectors. Binaries are told apart by their leading
    bytes, and unknown formats left out."""
    parsed = (F.col("kind") == "certificate") & F.col("text").rlike(PARSED)
    plain = F.col("kind").isin("text", "certificate") & ~F.coalesce(parsed, F.lit(False))
    content = F.col("content") if "content" in routed.columns else F.lit(None).cast("binary")
    files = routed.select("path", F.when(plain, F.col("text")).alias("text"), F.when(parsed, F.col("text")).alias("keys"), F.when(F.col("kind") == "binary", content).alias("content"))
    text = F.col("text")
    files = files.select("*", split_lines(text).alias("lines"), callsites.python_calls(text).alias("calls"), binaries.binary_format(F.col("path"), F.col("content")).alias("fmt"))
    return exploded(
        files, keymaterial.key_facts(F.col("keys")), keymaterial.certificate_facts(F.col("keys")), keymaterial.container_facts(),
        callsites.call_facts(F.col("calls")), config.config_facts(text), manifests.manifest_facts(text), containers.container_facts(text),
        lexical.line_facts(text), binaries.binary_facts(F.col("fmt"), F.col("content")))


def file_counts() -> dict[str, Column]:
    """Coverage counters over routed files."""
    base, ext, kind, reason = basename(F.col("path")), extension(F.col("path")), F.col("kind"), F.col("skip_reason")
    text = kind == "text"
    read = ~F.coalesce(reason.isin("ignored-extension", "too-large"), F.lit(False))
    counts = {
        "files_seen": F.count(F.lit(1)), "files_analyzed": F.count_if(kind != "skipped"), "skipped_files": F.count_if(kind == "skipped"),
        "bytes_analyzed": F.coalesce(F.sum(F.when(read, F.col("length"))), F.lit(0)), "manifests": F.count_if(text & base.isin(*MANIFESTS)),
        "configs": F.count_if(text & (ext.isin(*CONFIG_EXT) | F.contains(F.lower(base), F.lit("config")))), "binaries": F.count_if(kind == "binary")}
    counts |= {f"skipped {r}": F.count_if(reason == r) for r in SKIP_REASONS}
    return counts | {f"language {n}": F.count_if(text & (language_of(F.col("path")) == n)) for n in sorted(set(LANGUAGES.values()))}


#: Counters that facts answer; the files of containers are counted apart.
FACT_COUNTS = {"certificates": "certificate", "private_keys": "private-key", "key_containers": "key-container", "declared_packages": "dependency", "calls": "call"}


class Facts:
    """The facts of one scan, written once, and the counters the scan observed."""

    def __init__(self, routed: DataFrame):
        files, facts = Observation(), Observation()
        counted = routed.observe(files, *[c.alias(n) for n, c in file_counts().items()])
        found = file_facts(counted).observe(facts, *[F.count_if(F.col("fact") == f).alias(n) for n, f in FACT_COUNTS.items()])
        self.table = write_stage(found, "facts")
        self.counters: dict[str, int] = {**files.get, **facts.get}

    def detections(self, as_of: Column, certificates: DataFrame | None = None, linkage: DataFrame | None = None, symbols: DataFrame | None = None) -> DataFrame:
        """All detections. Parsed certificates, linkage and symbol tables come from ordinary
        tools; a linked library without a version takes the one its binary names."""
        parts = [r(self.table) for r in REFINERS]
        if certificates is not None:
            parts.append(certificate_detections(certificates, as_of))
        if linkage is not None:
            named = binaries.openssl_versions(self.table).withColumnRenamed("openssl_version", "named")
            linkage = linkage.join(named, "file", "left").withColumn("openssl_version", F.coalesce("openssl_version", "named")).drop("named")
            parts.append(binaries.linkage_detections(linkage))
        if symbols is not None:
            parts.append(binaries.symbol_detections(symbols))
        return reduce(DataFrame.unionByName, parts)

    def coverage(self, detections: DataFrame) -> DataFrame:
        """(counter, name, n): what the scan counted, and detections by detector. Containers are
        files with container detections, dependencies are detections of declared packages."""
        spark = detections.sparkSession
        split = [(*(k.split(" ", 1) if " " in k else ("scan", k)), int(n)) for k, n in self.counters.items()]
        scanned = spark.createDataFrame([r for r in split if r[0] == "scan" or r[2]], "counter string, name string, n long")
        by_detector = detections.groupBy(F.col("detector").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"))
        named = by_detector.select(F.explode(F.array(
            F.struct(F.lit("detector").alias("counter"), "name", "n"),
            F.when(F.col("name") == "container", F.struct(F.lit("scan").alias("counter"), F.lit("containers").alias("name"), F.col("files").alias("n"))),
            F.when(F.col("name") == "dependency-manifest", F.struct(F.lit("scan").alias("counter"), F.lit("dependencies").alias("name"), "n")))).alias("c"))
        return scanned.unionByName(named.where("c IS NOT NULL").select("c.*"))


def detect(routed: DataFrame, as_of: Column, certificates: DataFrame | None = None,
           linkage: DataFrame | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """Detections of ``routed`` files, which have path, kind, length and text (and content for
    binaries)."""
    return Facts(routed).detections(as_of, certificates, linkage, symbols)

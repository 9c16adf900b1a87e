"""Dependency manifests to library detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import basename, let, lookup, present
from ..functions.packages import capability, resolve_package, with_library
from ..functions.text import find_all, newlines, split_lines
from ..sources.schemas import DETECTOR_RANK, conform
from .facts import FACTS, fact, facts_of, found, together

# Manifest file name -> ecosystem.
MANIFESTS = {
    "requirements.txt": "pypi", "requirements-dev.txt": "pypi", "pyproject.toml": "pypi",
    "Pipfile": "pypi", "setup.py": "pypi", "package.json": "npm", "package-lock.json": "npm",
    "pom.xml": "maven", "build.gradle": "gradle", "build.gradle.kts": "gradle", "go.mod": "go",
    "go.sum": "go", "Cargo.toml": "cargo", "Cargo.lock": "cargo", "Gemfile": "rubygems",
    "composer.json": "composer", "packages.config": "nuget",
}
PY_STOP = ("python", "r", "e", "c", "git+https", "requires", "dependencies", "name", "version", "description")
# Patterns of each ecosystem.
PY_REQUIREMENT = (r"(?md)^\s*([A-Za-z0-9._-]+)\s*(?:\[[^\]]*\])?\s*"
                  r"(?:[=<>!~]=?\s*([0-9][A-Za-z0-9._+-]*))?")
GO_MODULE = (r"(?imd)^\s*(?:require\s+)?([a-z0-9./_-]+\.[a-z]{2,}/[^\s]+|crypto/[a-z0-9/]+)"
             r"\s+v?([0-9][^\s]*)")
CARGO_LINE = r'^\s*([a-zA-Z0-9_-]+)\s*=\s*(?:"([^"]+)"|\{[^}]*version\s*=\s*"([^"]+)")'
CARGO_SECTION = r"(?md)^[ \t]*(\[[^\n]*)((?:\n(?![ \t]*\[)[^\n]*)*)"
GRADLE = r"""['"]([a-zA-Z0-9._-]+):([a-zA-Z0-9._-]+):([0-9][A-Za-z0-9._-]*)['"]"""
MAVEN = r"(?s)<dependency>(.*?)</dependency>"


def _value(c: Column) -> Column:
    return F.when(c != "", c)


def _named(facts: Column, *names: str) -> Column:
    return F.when(basename(F.col("path")).isin(*names), facts)


def _dependency(eco: str, name: Column, version: Column, line, pos: Column, direct: bool = True) -> Column:
    return fact("dependency", rule=int(direct), line=line, pos=pos, a=name, b=version, c=eco)


def python_facts(text: Column) -> Column:
    rows = F.filter(find_all(text, PY_REQUIREMENT, name=1, version=2), lambda m: ~F.lower(m["name"]).isin(*PY_STOP))
    return _named(F.transform(rows, lambda m: _dependency("pypi", m["name"], _value(m["version"]), m["line"], m["pos"])), *[m for m, e in MANIFESTS.items() if e == "pypi"])


def npm_facts(text: Column) -> Column:
    def section(name: str, first: int, direct: bool) -> Column:
        def row(e, k):
            before = F.substring(text, F.lit(1), F.greatest(F.lit(0), F.instr(text, F.concat(F.lit('"'), e["key"], F.lit('"'))) - 1))
            return _dependency("npm", e["key"], F.regexp_replace(e["value"], r"^[\^~>=< ]+", ""), newlines(before) + 1, k + first, direct)

        return F.transform(F.map_entries(F.from_json(text, f"struct<{name}:map<string,string>>")[name]), row)

    return _named(together(section("dependencies", 0, True), section("devDependencies", 100_000, False), section("optionalDependencies", 200_000, False)), "package.json")


def npm_lock_facts(text: Column) -> Column:
    entry = "map<string,struct<version:string>>"

    def of_doc(doc):
        used = F.map_entries(F.when(F.size(doc["packages"]) > 0, doc["packages"]).otherwise(doc["dependencies"]))
        name = lambda e: F.coalesce(_value(F.element_at(F.split(e["key"], "node_modules/"), -1)), _value(doc["name"]))
        return F.transform(used, lambda e, k: F.when(e["value"].isNotNull() & name(e).isNotNull(), _dependency("npm", name(e), e["value"]["version"], 1, k, False)))

    doc = F.from_json(text, f"struct<name:string, packages:{entry}, dependencies:{entry}>")
    return _named(F.array_compact(let(doc, of_doc)), "package-lock.json")


def maven_facts(text: Column) -> Column:
    def row(m):
        tag = lambda t: _value(F.regexp_extract(m["block"], f"<{t}>([^<]+)</{t}>", 1))
        return F.when(tag("artifactId").isNotNull(), _dependency("maven", F.concat_ws(":", tag("groupId"), tag("artifactId")), tag("version"), m["line"], m["pos"]))

    return _named(F.array_compact(found(text, MAVEN, row, block=1)), "pom.xml")


def gradle_facts(text: Column) -> Column:
    return _named(found(text, GRADLE, lambda m: _dependency("gradle", F.concat_ws(":", m["g"], m["a"]), m["v"], m["line"], m["pos"]), g=1, a=2, v=3), "build.gradle", "build.gradle.kts")


def go_facts(text: Column) -> Column:
    return _named(found(text, GO_MODULE, lambda m: _dependency("go", m["name"], m["version"], m["line"], m["pos"]), name=1, version=2), "go.mod", "go.sum")


def cargo_facts(text: Column) -> Column:
    """Only lines inside a section whose header names dependencies."""
    def section(s):
        def row(line, i):
            g = lambda n: _value(F.regexp_extract(line, CARGO_LINE, n))
            return F.when(g(1).isNotNull(), _dependency("cargo", g(1), F.coalesce(g(2), g(3)), s["line"] + i, s["line"] + i))

        return F.when(F.contains(s["head"], F.lit("dependencies")), F.array_compact(F.transform(split_lines(s["body"]), row))).otherwise(F.array().cast(FACTS))

    return _named(F.flatten(found(text, CARGO_SECTION, section, head=1, body=2)), "Cargo.toml", "Cargo.lock")


def manifest_facts(text: Column) -> Column:
    return together(*[f(text) for f in (python_facts, npm_facts, npm_lock_facts, maven_facts, gradle_facts, go_facts, cargo_facts)])


def dependencies(facts: DataFrame) -> DataFrame:
    """Declared packages of all manifests; the first (name, version) of a manifest wins."""
    rows = facts.where("fact = 'dependency'").select("path", F.col("a").alias("name"), F.col("b").alias("version"), F.col("c").alias("ecosystem"), "line", (F.col("rule") == 1).alias("direct"), F.col("pos").alias("ord"))
    return (rows.groupBy("path", F.lower("name").alias("k"), "version")
            .agg(F.min_by(F.struct("name", "ecosystem", "line", "direct", "ord"), "ord").alias("d"))
            .select("path", "version", "d.*"))


def dependency_detections(files: DataFrame) -> DataFrame:
    return refine(facts_of(files.where(basename(F.col("path")).isin(*MANIFESTS)), manifest_facts))


def refine(facts: DataFrame) -> DataFrame:
    """Cryptographic libraries among the declared packages."""
    # Names that agree but for case have one library, so other packages need not be grouped.
    known = facts.where(F.col("fact") == "dependency").where(resolve_package(F.col("a")).isNotNull())
    d = with_library(dependencies(known).withColumn("library", resolve_package(F.col("name"))))
    cap = capability(F.col("lib_pqc"), F.col("lib_since"), F.col("version"))
    return conform(d.select(
        F.col("path").alias("file"), F.lit(DETECTOR_RANK["dependency-manifest"]).alias("det_rank"), "ord",
        F.lit(0).alias("sub"), "line", F.lit("dependency-manifest").alias("detector"),
        F.lit("manifest").alias("method"), F.lit("high").alias("confidence"), "library",
        F.col("version").alias("library_version"), F.col("name").alias("package"),
        F.col("ecosystem").alias("language"),
        F.concat_ws("@", "name", F.when(present(F.col("version")), F.col("version"))).alias("matched"),
        F.when(F.col("direct"), "direct dependency").otherwise("transitive dependency").alias("reasoning"),
        F.lit("package-manifest").alias("api_call"), cap.alias("pqc_capability"),
        F.concat_ws(" ", "lib_name", "version", F.lit("capability"), cap).alias("pqc_note")))

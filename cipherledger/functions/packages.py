"""Package-name resolution and provider capability at a version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..knowledge import libraries as lib
from ..knowledge.tables import dimension
from .columns import case


def resolve_package(name: Column) -> Column:
    """Exact spelling, then the Go and Bouncy Castle prefixes, then the first listed
    spelling of at least six characters contained in the name."""
    key = F.lower(F.trim(name))
    rows = lib.package_rows()
    exact = F.create_map(*[F.lit(v) for _, p, l in rows for v in (p, l)])[key]
    first = F.try_element_at(F.transform(F.filter(
        F.array(*[F.struct(F.lit(p).alias("p"), F.lit(l).alias("l"))
                  for _, p, l in rows if len(p) >= 6]),
        lambda r: F.contains(key, r["p"])), lambda r: r["l"]), F.lit(1))
    return case((key.isNull() | (key == ""), None), (exact.isNotNull(), exact),
                (key.startswith("crypto/") | key.startswith("golang.org/x/crypto"), "go-crypto"),
                (key.startswith("org.bouncycastle") | key.startswith("bcprov"), "bouncycastle"),
                otherwise=first)


def version_parts(version: Column) -> Column:
    """Leading numeric parts of a version, compared element by element."""
    digits = F.transform(F.split(F.regexp_replace(version, "-", "."), r"\."),
                         lambda p: F.regexp_replace(p, r"[^0-9]", ""))
    flagged = F.transform(digits, lambda p, i: F.when(p == "", i))
    stop = F.coalesce(F.array_min(flagged), F.size(digits))
    parts = F.transform(F.slice(digits, 1, stop), lambda p: p.cast("long"))
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(0).cast("long")))


def capability(support: Column, since: Column, version: Column) -> Column:
    """Native support is downgraded to an add-on below the first native version."""
    old = (support == "native") & since.isNotNull() & version.isNotNull() & (version != "") & (
        version_parts(version) < version_parts(since))
    return case((support.isNull(), "unknown"), (old, "provider"), otherwise=support)


def with_library(df: DataFrame, library_col: str = "library") -> DataFrame:
    """Join the library dimension (fixed rows, broadcast)."""
    dim = dimension(df.sparkSession, lib.lib_rows(), lib.LIB_COLUMNS)
    return df.join(dim, F.col(library_col) == F.col("lib_id"), "left")

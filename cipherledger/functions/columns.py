"""Small column builders: ids, rounding, mapping, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def case(*pairs, otherwise=None) -> Column:
    """First matching condition wins; values may be columns or plain values."""
    col = None
    for cond, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        col = F.when(cond, value) if col is None else col.when(cond, value)
    tail = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return col.otherwise(tail)


def lookup(col: Column, mapping: dict, otherwise=None) -> Column:
    """A fixed mapping: a CASE when short, a literal map (less generated code) when long."""
    if len(mapping) <= 8 or any(v is None or isinstance(v, Column) for v in mapping.values()):
        return case(*[(col == k, v) for k, v in mapping.items()], otherwise=otherwise)
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), col)
    if otherwise is None:
        return found
    return F.coalesce(found, otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often a lambda in it reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def compact(*pairs) -> Column:
    """Array of the labels whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(c, v if isinstance(v, Column) else F.lit(v))
                                     for c, v in pairs]))


def present(col: Column) -> Column:
    return col.isNotNull() & (col != F.lit(""))


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix-`` and 16 hex digits of SHA-256 over the parts joined by ``|``; a null
    part is an empty string, not a missing one."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(joined, 256), 1, 16))


def round_tenth(x: Column) -> Column:
    """Round a double to one decimal, half to even on its exact binary value.

    ``20x`` is 16x + 4x; both terms are exact, so the rounding error of their sum is
    recovered exactly and tells on which side of a tie the value lies.
    """
    a, b = x * 16.0, x * 4.0
    s = a + b
    err = b - (s - a)
    odd = (F.pmod(s, F.lit(2.0)) == 1.0)
    tenths = (F.when(odd & (err > 0), F.ceil(s / 2.0).cast("double"))
              .when(odd & (err < 0), F.floor(s / 2.0).cast("double"))
              .otherwise(F.rint(s / 2.0)))
    return tenths / 10.0


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; a leading dot alone is no extension."""
    return F.lower(F.regexp_extract(basename(path), r"^.*[^.](\.[^.]*)$", 1))


def spread_nulls(key: Column, *seed: Column) -> Column:
    """A join key whose nulls hash to many values that match nothing, so unmatched rows
    of an outer join do not gather in one task."""
    return F.coalesce(key, F.concat(F.lit("\u0000"), F.xxhash64(*seed).cast("string")))


# Markers that make a whole snippet unsafe.
PRIVATE_KEY_MARKERS = (
    "BEGIN RSA PRIVATE KEY", "BEGIN PRIVATE KEY", "BEGIN EC PRIVATE KEY",
    "BEGIN OPENSSH PRIVATE KEY", "BEGIN ENCRYPTED PRIVATE KEY", "BEGIN DSA PRIVATE KEY",
    "BEGIN PGP PRIVATE",
)
SNIPPET_LIMIT = 180


def redact(snippet: Column) -> Column:
    """Whole-snippet redaction on a private-key marker; long base64-like tokens are
    replaced by their size; the rest is clipped."""
    s = F.regexp_replace(snippet, r"^\s+|\s+$", "")
    upper = F.upper(s)
    unsafe = F.lit(False)
    for m in PRIVATE_KEY_MARKERS:
        unsafe = unsafe | F.contains(upper, F.lit(m))
    strip = r"^['\"`,;()\[\]{}]+|['\"`,;()\[\]{}]+$"
    tokens = F.array_distinct(F.filter(
        F.transform(F.split(s, r"\s+"), lambda t: F.regexp_replace(t, strip, "")),
        lambda t: t.rlike(r"^[\p{L}\p{N}+/=]{40,}$")))
    masked = F.aggregate(tokens, s, lambda acc, t: F.replace(
        acc, t, F.concat(F.lit("[REDACTED:"), F.length(t).cast("string"), F.lit("B]"))))
    return (F.when(unsafe, F.lit("[REDACTED: private key material detected]"))
            .otherwise(F.substring(masked, 1, SNIPPET_LIMIT)))


GUARD_MARKER = "[REDACTED: private key material]"


def guard_keys(text: Column) -> Column:
    """Boundary guard for string sinks: whole private-key blocks first, then a clipped
    header together with the body that follows it."""
    whole = (r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]*?"
             r"-----END [A-Z0-9 ]*PRIVATE KEY-----")
    header = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[A-Za-z0-9+/=\s\\.-]*"
    marker = F.lit(GUARD_MARKER)
    return F.when(F.contains(text, F.lit("PRIVATE KEY-----")),
                  F.regexp_replace(F.regexp_replace(text, F.lit(whole), marker),
                                   F.lit(header), marker)).otherwise(text)

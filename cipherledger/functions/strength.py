"""Parameter strength of a concrete algorithm use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..knowledge import algorithms as kb
from .columns import case, lookup


def curve_bits(curve: Column) -> Column:
    return lookup(F.lower(F.trim(curve)), dict(kb.CURVE_STRENGTH))


def modulus_bits(size: Column) -> Column:
    steps = [(size >= s, b) for s, b in reversed(kb.MODULUS_STRENGTH)]
    return case(*steps, otherwise=kb.MODULUS_FLOOR_BITS)


def classical_bits(family: Column, default: Column, key_size: Column, curve: Column) -> Column:
    """Curve table, then modulus step or cipher key size, then the declared default."""
    sized = key_size.isNotNull() & (key_size != 0)
    return F.when(family.isNotNull(), F.coalesce(
        curve_bits(curve),
        F.when(sized & family.isin(*kb.MODULUS_FAMILIES), modulus_bits(key_size)),
        F.when(sized & (family == "AES") & key_size.isin(128, 192, 256), key_size),
        default)).cast("int")


def quantum_bits(qclass: Column, primitive: Column, classical: Column, default: Column) -> Column:
    """Zero where the primitive falls to Shor or is already broken; a hash keeps its
    bits; other Grover-reduced primitives keep half."""
    return case(
        (qclass.isNull(), None),
        (qclass.isin(kb.SHOR, kb.BROKEN), F.lit(0)),
        (primitive == "hash", classical),
        (qclass == kb.GROVER, F.when(classical != 0, F.floor(classical / 2).cast("int"))),
        otherwise=default).cast("int")


def classical_status(status: Column, bits: Column) -> Column:
    return case((status.isNull(), "unknown"), (status == "broken", "broken"),
                (bits.isNull(), "unknown"), (bits < 80, "broken"), (bits < 112, "weak"),
                (bits < 128, "legacy"), (bits < 192, "acceptable"), otherwise="strong")

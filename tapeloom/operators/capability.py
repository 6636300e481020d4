"""Capabilities of a producer, and checks of rows and of requirements against them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The known capabilities, in bit order.
KNOWN = ("l0.inbound.tap", "l0.inbound.auth_phase", "l0.outbound", "l0.outbound.observed", "l0.request", "l0.plaintext", "l0.plaintext.cause", "takeover", "zero_copy_frame", "drain_hook", "detach")


def has(capabilities: Column, name: str) -> Column:
    return F.array_contains(capabilities, name)


def missing(capabilities: Column, wanted: Column) -> Column:
    return F.array_sort(F.array_except(wanted, capabilities))


def unknown(capabilities: Column) -> Column:
    return F.array_sort(F.array_except(capabilities, F.array(*[F.lit(c) for c in KNOWN])))


def require(declared: Iterable[str], wanted: Iterable[str]) -> None:
    """Before a plan is built: an unmet capability is an error that names all of them."""
    unmet = sorted(set(wanted) - set(declared))
    if unmet:
        raise ValueError(f"missing capabilities: {', '.join(unmet)}")


def violation(capabilities: Column, *, reencoded: Column, n_plaintexts: Column, outbound: Column, claims_cause: Column) -> Column:
    """The first way in which a row goes beyond its producer's declaration, or null."""
    return (
        F.when(has(capabilities, "zero_copy_frame") & reencoded, "reencoded_despite_zero_copy")
        .when(~has(capabilities, "l0.plaintext") & (n_plaintexts > 0), "plaintexts_without_capability")
        .when(~has(capabilities, "l0.outbound.observed") & outbound, "outbound_without_capability")
        .when(~has(capabilities, "l0.plaintext.cause") & claims_cause, "cause_without_capability")
    )


def split_violations(rows: DataFrame, check: Column) -> tuple[DataFrame, DataFrame]:
    """(sound rows, quarantined rows with ``violation``)."""
    marked = rows.withColumn("violation", check)
    return marked.filter("violation is null").drop("violation"), marked.filter("violation is not null")

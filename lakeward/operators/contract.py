"""Contracts of feeds: canonical columns, declared aliases, recoverable keys."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import first_given, typed


class Blocked(ValueError):
    """A finding that stops a load before anything is written."""


@dataclass(frozen=True)
class Contract:
    columns: dict[str, str]
    key: tuple[str, ...]
    aliases: dict[str, str] = field(default_factory=dict)
    recoverable: dict[str, str] = field(default_factory=dict)


def unknown_columns(names: list[str], contract: Contract) -> list[str]:
    known = {*contract.columns, *contract.aliases, *contract.recoverable}
    return sorted(n for n in names if n not in known and not n.startswith("_"))


def assert_known(names: list[str], contract: Contract) -> None:
    """Undeclared columns block the load."""
    if found := unknown_columns(names, contract):
        raise Blocked(f"unknown_column_in_file: {', '.join(found)}")


def normalise(df: DataFrame, contract: Contract) -> DataFrame:
    """Aliases folded in, malformed keys recovered (flag ``_recovered``), all columns cast to the contract."""
    assert_known(df.columns, contract)
    present = set(df.columns)
    for name in contract.columns:
        given = [a for a, target in contract.aliases.items() if target == name and a in present]
        if name not in present:
            df = df.withColumn(name, F.lit(None).cast("string"))
        if given:
            df = df.withColumn(name, first_given(name, *given)).drop(*given)
    recovered = F.lit(False)
    for wrong, name in contract.recoverable.items():
        if wrong in present:
            hit = F.col(name).isNull() & F.col(wrong).isNotNull()
            recovered = recovered | hit
            df = df.withColumn("_recovered", recovered).withColumn(name, F.coalesce(F.col(name), F.col(wrong))).drop(wrong)
            recovered = F.col("_recovered")
    rest = [c for c in df.columns if c.startswith("_") and c != "_recovered"]
    flag = F.col("_recovered") if "_recovered" in df.columns else F.lit(False)
    return df.select(*(typed(c, k) for c, k in contract.columns.items()), *rest, flag.alias("_recovered"))

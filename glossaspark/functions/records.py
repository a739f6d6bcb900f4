"""Closed JSON records: exact key sets and typed fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_faults(record: Column, expected: list[str]) -> Column:
    """Struct of the missing and the extra keys of a JSON object, each sorted; null for
    what is no object."""
    keys = F.json_object_keys(record)
    wanted = F.array(*[F.lit(k) for k in expected])
    faults = F.struct(
        F.sort_array(F.array_except(wanted, keys)).alias("missing"), F.sort_array(F.array_except(keys, wanted)).alias("extra")
    )
    return F.when(keys.isNotNull(), faults)


def closed(record: Column, expected: list[str]) -> Column:
    faults = key_faults(record, expected)
    return F.coalesce((F.size(faults["missing"]) == 0) & (F.size(faults["extra"]) == 0), F.lit(False))


def is_integer(record: Column, field: str, least: int | None = None) -> Column:
    """The field is a JSON integer, not a boolean, text or fraction."""
    raw = F.get_json_object(record, f"$.{field}")
    quoted = record.rlike(rf'"{field}"\s*:\s*"')
    ok = raw.rlike(r"^-?[0-9]+\z") & ~quoted
    if least is not None:
        ok &= raw.try_cast("long") >= least
    return F.coalesce(ok, F.lit(False))


def is_text(record: Column, field: str) -> Column:
    """The field is a JSON text that is not empty."""
    raw = F.get_json_object(record, f"$.{field}")
    return F.coalesce(record.rlike(rf'"{field}"\s*:\s*"') & (raw != ""), F.lit(False))

"""Reproducible uniform draws: a function of a seed and a row's own keys.

rand() depends on how rows are partitioned; these do not, and DuckDB computes the
same numbers, so sampling operators can be checked row by row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5 over seed and keys."""
    parts = [F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("long").cast("double") / F.lit(4294967296.0)


def uniform_sql(seed: int, *keys: str) -> str:
    """The same number as a DuckDB expression."""
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE)"

"""Feature standardisation: zero mean, unit population variance per column
(a constant column maps to 0). The statistics are one global aggregate
(2 numbers per column reach the driver); the transform is a projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_standardizer(df: DataFrame, cols) -> dict[str, tuple[float, float]]:
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m_{c}"), F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    out = {}
    for c in cols:
        m, s = row[f"m_{c}"], row[f"s_{c}"]
        out[c] = (m or 0.0, s if s and s > 0 else 1.0)
    return out


def standardize(df: DataFrame, cols, stats: dict[str, tuple[float, float]] | None = None,
                suffix: str = "") -> DataFrame:
    """Replace (or add with ``suffix``) each column by (x - mean) / std."""
    stats = stats or fit_standardizer(df, cols)
    return df.withColumns({f"{c}{suffix}": (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(stats[c][0]))
                           / F.lit(stats[c][1]) for c in cols})

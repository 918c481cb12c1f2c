"""Bounded samples of labelled rows, for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Draws of the hash that picks sampled rows.
DRAWS = 1 << 30


def draw(id_col: str, seed: int) -> Column:
    """A number in [0, DRAWS) that depends on the id alone."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.lit(DRAWS))


def stratified(rows: DataFrame, stratum: str, id_col: str, per_stratum: int, seed: int = 17) -> DataFrame:
    """About per_stratum rows of each stratum at most, chosen by a hash of the id.

    Strata are counted over all rows first; no sort and no shuffle of the rows themselves. The strata
    (label values) come to the driver.
    """
    counts = {r[stratum]: r["n"] for r in rows.where(F.col(stratum).isNotNull()).groupBy(stratum).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows.where(F.lit(False))
    limits = F.create_map(*[x for value, n in counts.items() for x in (F.lit(value), F.lit(int(DRAWS * min(1.0, per_stratum / n))))])
    return rows.where(F.col(stratum).isNotNull() & (draw(id_col, seed) < F.element_at(limits, F.col(stratum))))

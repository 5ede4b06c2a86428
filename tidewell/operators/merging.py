"""Fields filled from another table, counted in the same pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def filled(rows: DataFrame, side: DataFrame, key: str, field: str, order: list[str], name: str = "merge") -> tuple[DataFrame, Observation]:
    """(rows, with `field` from the side's last row of that key, or else their own; total, matched and unmatched, once the rows are written).

    side: key, the field and `order`. Of the side, rows of null or empty field don't count; of several for one key the last in
    order wins. The counts are observed on the way of the rows, so they cost no pass of their own. Rows of null key match nothing.
    """
    last = side.filter(F.col(field).isNotNull() & (F.col(field).cast("string") != "")).groupBy(F.col(key).alias("__key")).agg(F.max_by(field, F.struct(*order)).alias("__found"))
    joined = rows.join(last, F.col(key) == F.col("__key"), "left")
    counts, has = Observation(name), F.col("__found").isNotNull()
    own = F.col(field) if field in rows.columns else F.lit(None)
    seen = joined.observe(counts, F.count(F.lit(1)).alias("total"), F.count_if(has).alias("matched"), F.count_if(~has).alias("unmatched"))
    return seen.select(*(c for c in rows.columns if c != field), F.coalesce("__found", own).alias(field)), counts

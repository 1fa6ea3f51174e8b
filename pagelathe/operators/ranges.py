"""Range joins by bands: what meets must share a band of a document's page, so that no page is compared as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Height of a band, in points: about four lines of text.
BAND = 50.0


def banded(df: DataFrame, low: Column, high: Column) -> DataFrame:
    """df once for every band that low to high touches: _band, and _first, the lowest of its bands."""
    at = lambda v: F.floor(v / BAND).cast("int")
    return df.withColumn("_first", at(F.least(low, high))).withColumn("_band", F.explode(F.sequence(F.col("_first"), at(F.greatest(low, high)))))


def shares_band(a: str, b: str) -> Column:
    """Rows of aliases a and b in one band of one page, each pair once: in the first band that both touch."""
    same = (F.col(f"{a}.doc_id") == F.col(f"{b}.doc_id")) & (F.col(f"{a}.page") == F.col(f"{b}.page")) & (F.col(f"{a}._band") == F.col(f"{b}._band"))
    return same & (F.col(f"{a}._band") == F.greatest(F.col(f"{a}._first"), F.col(f"{b}._first")))

"""SQL functions registered as expressions (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFINITIONS = [
    """CREATE OR REPLACE TEMPORARY FUNCTION decay_score(kind STRING, days DOUBLE, ttl DOUBLE) RETURNS DOUBLE
       RETURN CASE kind WHEN 'linear' THEN greatest(0D, 1 - greatest(days, 0D) / greatest(ttl, 1D)) WHEN 'step' THEN IF(greatest(days, 0D) <= greatest(ttl, 1D), 1D, 0.05D)
       ELSE power(2D, -greatest(days, 0D) / greatest(0.5D, greatest(ttl, 1D) / 2)) END""",
    """CREATE OR REPLACE TEMPORARY FUNCTION atom_ttl(kind STRING, importance DOUBLE, reinforced BIGINT, event_days DOUBLE) RETURNS DOUBLE
       RETURN greatest(1D, (CASE kind WHEN 'episodic' THEN 7D WHEN 'planned' THEN 2D + greatest(coalesce(event_days, 0D), 0D) WHEN 'factual' THEN 180D WHEN 'relational' THEN 90D WHEN 'preference' THEN 60D ELSE 30D END)
       * (0.5D + importance) * (1 + least(0.5D, 0.1D * reinforced)))""",
    """CREATE OR REPLACE TEMPORARY FUNCTION jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE
       RETURN IF(size(array_union(a, b)) > 0, size(array_intersect(a, b)) / size(array_union(a, b)), 0D)""",
    """CREATE OR REPLACE TEMPORARY FUNCTION cosine(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE
       RETURN aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, v) -> s + v)""",
]


def register(spark: SparkSession) -> None:
    for d in DEFINITIONS:
        spark.sql(d)

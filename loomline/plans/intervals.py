"""Queries of problem 4: periods and gaps of speakers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.intervals import milliseconds, periods_and_gaps
from loomline.sources.tables import table


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """Every continuous period of each speaker of each media item, and every gap between two."""
    spans = table(spark, base, "segments", ["media_id", "speaker_id", "start_s", "end_s"]).where(F.col("speaker_id").isNotNull())
    found = periods_and_gaps(spans, ["media_id", "speaker_id"], "start_s", "end_s")
    return found.select("media_id", "speaker_id", "kind", milliseconds(F.col("from_s")).alias("from_ms"), milliseconds(F.col("to_s")).alias("to_ms"))


QUERIES = {"p4_found": p4_found}

SQL = {
    "p4_found": """
WITH v AS (SELECT media_id, speaker_id, start_s, end_s, seg_id FROM segments
           WHERE speaker_id IS NOT NULL AND end_s > start_s AND NOT isnan(start_s) AND NOT isnan(end_s)),
m AS (SELECT *, max(end_s) OVER (PARTITION BY media_id, speaker_id ORDER BY start_s, end_s, seg_id
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR start_s > before THEN 1 ELSE 0 END)
             OVER (PARTITION BY media_id, speaker_id ORDER BY start_s, end_s, seg_id ROWS UNBOUNDED PRECEDING) AS island FROM m),
p AS (SELECT media_id, speaker_id, island, min(start_s) AS a, max(end_s) AS b FROM i GROUP BY ALL),
g AS (SELECT media_id, speaker_id, lag(b) OVER (PARTITION BY media_id, speaker_id ORDER BY island) AS a, a AS b FROM p)
SELECT media_id, speaker_id, 'period' AS kind, CAST(round(a * 1000) AS BIGINT) AS from_ms, CAST(round(b * 1000) AS BIGINT) AS to_ms FROM p
UNION ALL
SELECT media_id, speaker_id, 'gap', CAST(round(a * 1000) AS BIGINT), CAST(round(b * 1000) AS BIGINT) FROM g WHERE a IS NOT NULL
""",
}

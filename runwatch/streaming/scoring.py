"""The batch scorers on a stream: row-wise, stateless, models broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.detector import FittedDetector


def score_stream(
    stream: DataFrame, models: FittedDetector, out: str, checkpoint: str,
    columns: list[str] | None = None,
) -> StreamingQuery:
    """Score everything available on ``stream`` and append it to Parquet, exactly once.

    Progress is kept in ``checkpoint``, so a lost executor or driver resumes
    where it stopped.
    """
    scored = models.predict(stream)
    if columns is not None:
        scored = scored.select(*columns)
    return (
        scored.writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )

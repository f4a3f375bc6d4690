"""Scoring files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from labelloom.plans.experiment import TextScorer


def score_stream(spark: SparkSession, source: str, schema: StructType, scorer: TextScorer, sink: str,
                 progress: str, text: str = "text", keep: list[str] | None = None,
                 files_per_trigger: int = 1000, **source_options: str) -> StreamingQuery:
    """Score all Parquet files available at ``source`` into the Parquet folder ``sink``.

    With a vocabulary of shippable size the batch scoring plan is a stateless projection, so it
    runs on the stream unchanged; the file sink with its ``progress`` folder gives each input
    file exactly one output, also after a restart. A larger vocabulary is joined, one batch of
    files at a time; a batch overwrites its own folder ``batch=<number>`` when it is repeated.
    Both folders must be on shared storage, and one sink takes one of the two forms.
    """
    arriving = (spark.readStream.schema(schema).options(**source_options)
                .option("maxFilesPerTrigger", files_per_trigger).parquet(source))
    rows = arriving.withColumnRenamed(text, "text").select(*(keep or []), "text")
    if scorer.features.size and not scorer.features.shippable:
        def write_batch(batch: DataFrame, number: int) -> None:
            scorer.score(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

        return (rows.writeStream.foreachBatch(write_batch).option("checkpointLocation", progress)
                .trigger(availableNow=True).start())
    return (scorer.score(rows).writeStream.format("parquet").outputMode("append")
            .option("path", sink).option("checkpointLocation", progress)
            .trigger(availableNow=True).start())

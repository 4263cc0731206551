"""The redaction plan over a stream: stateless, so any trigger and any late row is fine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from veilspark.plans.config import Config
from veilspark.plans.pipeline import redact


def records(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string") -> DataFrame:
    """A stream of Parquet files of records."""
    return spark.readStream.schema(schema).parquet(path)


def start(stream: DataFrame, target: str, checkpoint: str, config: Config | None = None, once: bool = True) -> StreamingQuery:
    """Redacts each micro-batch and appends it under its batch id; a replayed batch replaces itself."""
    chosen = config or Config()

    def put(batch: DataFrame, batch_id: int) -> None:
        redact(batch, chosen).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

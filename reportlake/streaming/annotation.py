"""Annotation as a stream: new report files are annotated batch by batch and appended once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reportlake.operators.annotate import Sampling, annotated
from reportlake.schema import REPORTS
from reportlake.shipping import shipped


def annotate_stream(spark: SparkSession, source: str, target: str, checkpoint: str, model: str = "stub", sampling: Sampling | None = None, files_a_batch: int = 5):
    """Annotate Parquet reports that appear in `source` into `target`, and stop when nothing is new.

    Each batch goes to a folder of its own number, so a batch that is tried again after a failure replaces its
    own rows and no others; ids that earlier batches hold are left out, so a report is annotated once.
    """
    shipped(spark)
    stream = spark.readStream.schema(REPORTS).option("maxFilesPerTrigger", files_a_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(["report_id"])
        if number:
            done = spark.read.schema("report_id string, batch int").option("basePath", target).parquet(target).where(f"batch < {number}")
            new = new.join(done.select("report_id"), "report_id", "left_anti")
        annotated(new, model, sampling).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def supervised(work, most: int = 3, on_failure=None):
    """Run work() again after a failure, `most` times at the most; the last error is raised."""
    for attempt in range(1, most + 1):
        try:
            return work()
        except Exception as error:
            if on_failure is not None:
                on_failure(attempt, error)
            if attempt == most:
                raise

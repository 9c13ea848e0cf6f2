"""A review of accounts as they arrive: the batch operators over each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.review import Settings, analyse


def review_stream(accounts: DataFrame, settings: Settings, table: str, checkpoint: str, known: dict | None = None):
    """Start a query that analyses each micro-batch and appends it to a Parquet table, with its batch's number.

    Conventions of date columns are given, not detected, so that all batches read dates
    alike. A batch that is run again overwrites its own partition."""

    def write(batch: DataFrame, number: int) -> None:
        analyse(batch, settings, known=known or {}).drop("risk_score_reasons").write.mode("overwrite").parquet(f"{table}/batch={number}")

    return accounts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

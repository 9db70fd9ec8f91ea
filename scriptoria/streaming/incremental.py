"""Incremental runs over arriving rows: each micro-batch is checked and its new answers are appended to the cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptoria.functions.text import content_key
from scriptoria.operators.cache import append, open_cache
from scriptoria.operators.lint import review
from scriptoria.plans.models import Summariser
from scriptoria.plans.summarise import ask


def latest_deliveries(rows: DataFrame, key: str, arrived: str, delay: str = "60 days") -> DataFrame:
    """A stream without the repeated deliveries of a key that arrive within ``delay`` of each other."""
    return rows.withWatermark(arrived, delay).dropDuplicatesWithinWatermark([key])


def lint_stream(pages: DataFrame, id_col: str, html_col: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append the findings of arriving pages to the parquet folder ``out``; a repeated batch replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        review(batch, id_col, html_col).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summarise_stream(texts: DataFrame, model: Summariser, kind: str, cache: str, checkpoint: str) -> StreamingQuery:
    """Summarise arriving texts (text) that the cache at ``cache`` lacks; a repeated batch finds its answers there."""

    def write(batch: DataFrame, number: int) -> None:
        prompts = batch.where("text is not null").select("text", content_key(kind, F.col("text")).alias("key"))
        append(ask(prompts, model, open_cache(batch.sparkSession, cache), kind)[1], cache)

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

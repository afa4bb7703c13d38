"""Screening of sequences: in batches, resumable, and as a bounded stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import truncated
from ..operators.learning import ensemble_mean
from ..sources.tables import hit_name

Scorer = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def workers(records: int, per_device: int = 40_000, devices: int = 8) -> int:
    """How many workers a file of so many records needs."""
    return records // (per_device * devices) + 1


def scored(sequences: DataFrame, load: Callable[[], Scorer], classes: Sequence[str], batch: int = 4096, id_col: str = "id", sequence: str = "sequence") -> DataFrame:
    """(id, class, score, error): long scores of a model that each worker process loads once.

    A batch that runs out of memory is scored row by row; rows that fail even so
    are returned with their error and no score, and do not end the job.
    """
    state: dict = {}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if "model" not in state:
            state["model"] = load()
        model = state["model"]
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                try:
                    rows = [(i, list(s), None) for i, s in zip(part["id"], model(list(part["sequence"])), strict=True)]
                except MemoryError:
                    rows = []
                    for i, s in zip(part["id"], part["sequence"], strict=True):
                        try:
                            rows.append((i, list(model([s])[0]), None))
                        except MemoryError as e:
                            rows.append((i, [None] * len(classes), f"out of memory: {e}"))
                yield pd.DataFrame([(i, c, x, e) for i, scores, e in rows for c, x in zip(classes, scores, strict=True)], columns=["id", "class", "score", "error"])

    own = sequences.select(F.col(id_col).cast("string").alias("id"), truncated(F.col(sequence)).alias("sequence"))
    return own.mapInPandas(run, "id string, class string, score double, error string")


def hits(scores: DataFrame, models: int, classes: Sequence[str], threshold: float, detected: str = "isTPS", precursor: str | None = None) -> DataFrame:
    """(id, class columns, name) of ids at or above the threshold, by the ensemble's mean score."""
    wide = ensemble_mean(scores, models).groupBy("id").pivot("class", [c.replace("-", "_") for c in classes]).agg(F.first("score"))
    keep = F.col(detected) >= threshold
    if precursor:
        keep = keep | F.coalesce(F.col(precursor) >= threshold, F.lit(False))
    return wide.where(keep).withColumn("name", hit_name(F.col("id")))


def screen_stream(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_a_batch: int = 8, done_on: str = "id") -> None:
    """Runs ``transform`` over new files of ``source`` and appends to ``sink``, then stops.

    The checkpoint makes a restart go on after the last finished batch.  Every batch
    has its own folder ``batch=n`` of the sink, so a batch that was written but not
    committed is written over, and no batch reads the sink.  Of rows with one id only
    the first is screened: the ids of every batch are written beside the checkpoint
    and joined against, so no state grows in memory.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    seen = f"{checkpoint.rstrip('/')}-seen"

    def write(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates([done_on])
        if number:
            before = spark.read.parquet(*[f"{seen}/batch={k}" for k in range(number)]).select(done_on)
            new = new.join(before, done_on, "left_anti").select(*batch.columns)
        new.select(done_on).write.mode("overwrite").parquet(f"{seen}/batch={number}")
        own = spark.read.parquet(f"{seen}/batch={number}")
        transform(batch.dropDuplicates([done_on]).join(own, done_on, "left_semi").select(*batch.columns)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

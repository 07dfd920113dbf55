"""Streams run over what is there and read back, each row exactly once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import shared_folder

EPOCH = "epoch"


def epoch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes each micro-batch to a folder of its own.

    A batch that runs again after a failure replaces what its first try wrote, so its rows stand there once.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{EPOCH}={epoch}")
    return write


def drained(stream: DataFrame, mode: str = "append", write: Callable[[str], Callable[[DataFrame, int], None]] = epoch_writer) -> DataFrame:
    """Run a stream over all that its source holds now, and read what it wrote, with the ``epoch`` of each row.

    State and offsets are kept in the shared folder, where a restarted query would go on.
    """
    path = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    query = (stream.writeStream.outputMode(mode).foreachBatch(write(f"{path}/rows"))
             .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    schema = T.StructType([*stream.schema, T.StructField(EPOCH, T.LongType())])
    return stream.sparkSession.read.schema(schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows")


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows that update one another, those of each key's last epoch."""
    rest = [c for c in rows.columns if c not in (*keys, EPOCH)]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), EPOCH).alias("_last"))
    return last.select(*keys, "_last.*")

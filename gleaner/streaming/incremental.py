"""Incremental intake: chunk files that have arrived since the last run join a table.

A batch in stream's clothing: the trigger takes what is there and stops, and the
checkpoint remembers which files were seen. Upserts are by id, so a batch that is
repeated after a failure changes nothing. Of rows of a batch that share an id the
one from the file that was written last stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.schema import CHUNK_SCHEMA
from gleaner.operators.store import Store


def take_in(store: Store, name: str, folder: str, checkpoint: str, files_per_batch: int = 1_000) -> int:
    """Upsert the Parquet files in ``folder`` that are new; says how many batches there were."""
    store.ensure(name)
    seen: list[int] = []

    def add(batch: DataFrame, number: int) -> None:
        # Times first, then paths and contents, so that the choice never depends on the layout.
        when = F.struct("_written", "_file", F.to_json(F.struct(*CHUNK_SCHEMA.names)))
        newest = batch.groupBy("id").agg(F.max_by(F.struct(*CHUNK_SCHEMA.names), when).alias("row")).select("row.*")
        store.upsert(name, newest)
        seen.append(number)

    files = store.spark.readStream.schema(CHUNK_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    files = files.select("*", F.col("_metadata.file_modification_time").alias("_written"), F.col("_metadata.file_path").alias("_file"))
    files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return len(seen)

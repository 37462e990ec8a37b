"""Resumable graph building: new chunks only, once each, failures kept for another try."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie import schemas
from kelpie.operators.answer import extract
from kelpie.operators.graph import validate_extractions


def remaining(chunks: DataFrame, processed: DataFrame) -> DataFrame:
    return chunks.join(processed.select("chunk_id"), "chunk_id", "left_anti")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one where nothing is stored yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


PROGRESS = "chunk_id string"
DEAD = "chunk_id string, chunk_ord long, source_file string, raw string"


def run_increment(spark: SparkSession, source: str, store: str, model: Callable[[list[dict]], str], checkpoint: str) -> None:
    """Extracts from chunk files that are new under `source` (Parquet, schemas.CHUNKS) and stops when there are no more.

    Each micro-batch appends entities, relations, progress and dead letters to tables under `store`, in folders named by the batch, so a batch
    that runs again overwrites its own. Chunks that gave an error (JSON of the wrong shape) go to dead letters and don't count as processed;
    skipped ones (no JSON twice) do.
    """

    def batch(df: DataFrame, no: int) -> None:
        own = df.sparkSession
        todo = remaining(df.dropDuplicates(["chunk_id"]), read_table(own, f"{store}/progress", PROGRESS).where(F.col("chunk_id").isNotNull()))
        todo = todo.withColumn("chunk_ord", F.xxhash64("chunk_id")) if "chunk_ord" not in todo.columns else todo
        at = f"{store}/raw/batch={no}"
        extract(todo, model).write.mode("overwrite").parquet(at)  # the model is asked once, whatever reads the answers
        raw = own.read.parquet(at)
        entities, relations, report = validate_extractions(raw)
        entities.write.mode("overwrite").parquet(f"{store}/entities/batch={no}")
        relations.write.mode("overwrite").parquet(f"{store}/relations/batch={no}")
        bad = report.where("state = 'error'").select("chunk_id")
        raw.select("chunk_id", "chunk_ord", "source_file", "raw").join(bad, "chunk_id").write.mode("overwrite").parquet(f"{store}/dead/batch={no}")
        report.where("state <> 'error'").select("chunk_id").write.mode("overwrite").parquet(f"{store}/progress/batch={no}")

    stream = spark.readStream.schema(schemas.CHUNKS).option("recursiveFileLookup", "true").parquet(source)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def budget(chunks: DataFrame, processed: DataFrame, per_phase: list[tuple[str, int]]) -> DataFrame:
    """chunks left, each with the phase (model) that takes it: the first quota in order to the first, and so on; the rest has none.

    A quota is a day's count of calls, so numbering takes the first of them by (ord, id) only.
    """
    out, total, phase = remaining(chunks, processed), sum(n for _, n in per_phase), F.lit(None).cast("string")
    first = out.orderBy("chunk_ord", "chunk_id").limit(total)
    from pyspark.sql import Window

    numbered = first.withColumn("_n", F.row_number().over(Window.orderBy("chunk_ord", "chunk_id")))
    upto = total
    for name, n in reversed(per_phase):
        phase = F.when(F.col("_n") <= upto, name).otherwise(phase)
        upto -= n
    return numbered.withColumn("phase", phase).drop("_n")

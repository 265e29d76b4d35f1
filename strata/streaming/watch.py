"""New source files as a stream: each micro-batch is scanned and appended to a table of symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.config import Config
from strata.runtime import ship
from strata.sources.python_code import scan_symbols


def watch(spark: SparkSession, folder: str, table: str, checkpoint: str, cfg: Config = Config()) -> StreamingQuery:
    """Scans the Python files that appear in a folder until all present ones are done.

    Files are read once each, as the checkpoint remembers them; a batch that failed half
    way is written again under its own number, so no symbol is appended twice.
    """
    ship(spark)
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.py").option("recursiveFileLookup", True).load(folder)

    def append(batch: DataFrame, number: int) -> None:
        rel = F.substring_index(F.col("path"), folder.rstrip("/") + "/", -1)
        scan_symbols(batch.select(rel.alias("file"), "content"), cfg).where(F.col("node_count") >= cfg.min_nodes).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return files.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

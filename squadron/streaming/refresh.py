"""K3 as a stream: landed gameweek documents refresh the score table.

The reference polls the API and re-runs the gameweek refresh in a loop.
Here a file-source stream watches the landing folder.  Each micro-batch is
flattened (S1) and appended to a log beside the table, every row with its
version: when its document was changed, then the document's path.  The batch's
gameweeks are then published: of the log's rows the newest of each (player,
gameweek), across all batches, replace the table's partitions.

* An older document that lands later changes nothing, as versions are compared
  with those of all earlier batches.
* Only the log is ever read again, and it is only appended to; a crash at any
  point leaves it whole.  The replayed batch appends rows that equal those there
  and publishes its gameweeks anew, also if the crash came while the table's
  partitions were being replaced.

With ``trigger(availableNow=True)`` the stream processes what has landed and
stops; the checkpoint location makes restarts exactly-once per file.  No
watermarks or state: the reference has no late-data rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squadron import schemas
from squadron.functions.lists import MAX_GW, valid_gameweek
from squadron.session import stage_table
from squadron.sources.documents import score_rows
from squadron.sources.sinks import append, newest_rows, refresh_gameweeks

GW_FROM_PATH = r"gameweek=(\d+)"
KEY = ("player_id", "gameweek")
VERSION = ("changed", "file_path")


def log_path(table_path: str) -> str:
    return f"{table_path.rstrip('/')}_log"


def record(rows: DataFrame, table_path: str) -> list[int]:
    """Append rows with their versions to the table's log; returns their
    gameweeks (38 at most)."""
    rows = stage_table(newest_rows(rows, KEY, VERSION).where(valid_gameweek("gameweek")), "refresh-rows")
    append(rows, log_path(table_path), partition_by="gameweek")
    return sorted(r.gameweek for r in rows.select("gameweek").distinct().limit(MAX_GW).collect())


def publish(spark: SparkSession, table_path: str, weeks: list[int]) -> None:
    """Replace the gameweeks' partitions by the log's newest rows; the other
    partitions of the log are not read, nor those of the table touched."""
    if weeks:
        rows = spark.read.parquet(log_path(table_path)).where(F.col("gameweek").isin(weeks))
        refresh_gameweeks(newest_rows(rows, KEY, VERSION).drop(*VERSION), table_path)


def start_gameweek_refresh(spark: SparkSession, landing: str, table_path: str,
                           checkpoint_location: str, multi_line: bool = True, available_now: bool = True):
    """Start the refresh stream; returns the StreamingQuery."""
    raw = (spark.readStream.schema(schemas.GAMEWEEK_DOC).option("multiLine", multi_line)
           .option("recursiveFileLookup", "true").json(landing)
           .select("*", F.col("_metadata.file_path").alias("file_path"),
                   F.col("_metadata.file_modification_time").alias("changed"))
           .withColumn("gameweek", F.regexp_extract("file_path", GW_FROM_PATH, 1).try_cast("int")))

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        publish(batch.sparkSession, table_path, record(score_rows(batch, *VERSION), table_path))

    w = raw.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="60 seconds")
    return w.start()

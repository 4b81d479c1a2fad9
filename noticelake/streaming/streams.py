"""The incremental operators as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from noticelake.operators import alerts
from noticelake.operators.tables import keep_last
from noticelake.schema import KEY
from noticelake.storage import fresh_path


def late_window(stream: DataFrame, ts: str, keys: list[str], days: int = 14) -> DataFrame:
    """A stream without repeated keys inside a window of days, in which late rows still count."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, f"{days} days").dropDuplicatesWithinWatermark(keys)


def trend(stream: DataFrame, ts: str, label: str) -> DataFrame:
    """Counts per month and label, kept up to date as rows arrive, however late.

    The state is one number per month and label; it grows with the calendar, not with the rows.
    """
    month = F.date_format(F.date_trunc("month", F.col(ts).cast("timestamp_ntz")), "yyyy-MM")
    return stream.groupBy(month.alias("month"), F.col(label).alias("label")).agg(F.count("*").alias("count"))


def sessions(stream: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Stretches of heartbeats of a key, closed once it has been quiet for the gap."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{gap_seconds} seconds")
    found = timed.groupBy(key, F.session_window(ts, f"{gap_seconds} seconds")).agg(F.count("*").alias("beats"))
    return found.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "beats")


class Batches:
    """A table of what micro-batches wrote, each in a folder of its own.

    Folders have increasing numbers and the names of the query and the batch that wrote them. A batch that runs again
    writes its own folder anew; folders without Spark's mark of success are not read. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def folders(self) -> list[str]:
        """Names of the folders that count, in order: from the last complete base on."""
        fs, at = self._fs()
        if not fs.exists(at):
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        names = sorted(f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory() and fs.exists(path(f.getPath(), "_SUCCESS")))
        bases = [n for n in names if n.endswith("-base")]
        return [n for n in names if not bases or n >= bases[-1]]

    def put(self, batch: DataFrame, query: str, number: int) -> None:
        own = f"-{query}-{number}"
        folders = self.folders()
        known = [n for n in folders if n.endswith(own)]
        following = int(folders[-1].split("-")[0]) + 1 if folders else 0
        if folders and folders[-1].endswith("-base") and self._folded(query, number):
            return
        batch.write.mode("overwrite").parquet(f"{self.path}/{known[0] if known else f'{following:012d}{own}'}")

    def _folded(self, query: str, number: int) -> bool:
        """Whether a batch went into a base already: its folder stands before it."""
        fs, at = self._fs()
        return any(f.getPath().getName().endswith(f"-{query}-{number}") for f in fs.listStatus(at))

    def rows(self, schema) -> DataFrame:
        """All rows of the folders that count, with ``arrived``, the number of the folder."""
        folders = self.folders()
        if not folders:
            return self.spark.createDataFrame([], schema).withColumn("arrived", F.lit(0).cast("long"))
        found = self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in folders])
        return found.withColumn("arrived", F.regexp_extract(F.input_file_name(), r"/(\d{12})-[^/]*/[^/]*$", 1).cast("long"))


def batches_into(stream: DataFrame, path: str, checkpoint: str, body=lambda batch: batch) -> StreamingQuery:
    """Writes ``body`` of every micro-batch into ``Batches(path)``; restarts repeat no row."""

    def put(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        Batches(batch.sparkSession, path).put(body(batch), query, number)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_into(stream: DataFrame, path: str, ordinal: str, checkpoint: str) -> StreamingQuery:
    """Upserts every micro-batch into the keyed table that ``ingested`` reads.

    A batch writes its own last rows only, whatever the table holds; later batches win when it is read.
    """
    return batches_into(stream, path, checkpoint, lambda batch: keep_last(batch, ordinal))


def ingested(spark: SparkSession, path: str, schema, keys: list[str] = KEY) -> DataFrame:
    """The keyed table: of every key the row that came with the last batch."""
    rows = Batches(spark, path).rows(schema)
    whole = F.struct(*[c for c in rows.columns if c != "arrived"])
    return rows.groupBy(*keys).agg(F.max_by(whole, "arrived").alias("row")).select("row.*")


def compact(spark: SparkSession, path: str, schema, keys: list[str] = KEY) -> None:
    """Folds all batches into a base, from which readers then start; run it while no stream writes. Readers of before are not disturbed."""
    table = Batches(spark, path)
    folders = table.folders()
    if len(folders) > 1:
        following = int(folders[-1].split("-")[0]) + 1
        ingested(spark, path, schema, keys).write.parquet(f"{table.path}/{following:012d}-base")


def match_into(notices: DataFrame, subs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Matches every micro-batch of notices against the stored subscriptions, by the plan that ``match`` has."""
    return batches_into(notices, path, checkpoint, lambda batch: alerts.match(batch, subs))


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is into files in the shared folder and returns them as a table.

    Appended rows go to a file sink; a complete result is written anew by every micro-batch.
    """
    spark = stream.sparkSession
    path, state = fresh_path(spark, name), fresh_path(spark, f"{name}-state")
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", path).start().awaitTermination()
    else:
        writer.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)

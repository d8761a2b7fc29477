"""T1 to T4 on Structured Streaming."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.tables import first_per_key


def ingest(spark: SparkSession, folder: str, schema, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Files of a folder as a stream; the query's checkpoint keeps which ones are done."""
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(folder)


def start_intake(df: DataFrame, out: str, checkpoint: str, parameters: dict, fmt: str = "parquet") -> StreamingQuery:
    """Append what is new to out and stop (availableNow). A checkpoint belongs to one set of parameters: its folder carries
    their digest, and a folder that is there with other parameters is refused."""
    spark = df.sparkSession
    digest = hashlib.sha256(json.dumps(parameters, sort_keys=True).encode()).hexdigest()
    mark = f"{checkpoint}/parameters"
    path = spark._jvm.org.apache.hadoop.fs.Path(mark)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        if spark.read.text(mark).first()[0] != digest:
            raise ValueError("the parameters differ from those of this checkpoint")
    else:
        spark.createDataFrame([(digest,)], "value string").coalesce(1).write.text(mark)
    return df.writeStream.format(fmt).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start(out)


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _epochs(spark: SparkSession, table_path: str) -> list[int]:
    """Micro-batches whose manifest is complete."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{table_path}/manifest")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    done = (int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch="))
    return sorted(e for e in done if _there(spark, f"{table_path}/manifest/epoch={e}/_SUCCESS"))


def _manifest(spark: SparkSession, table_path: str, epoch: int | None) -> dict[int, int]:
    """The epoch that wrote each bucket last: as many numbers as there are buckets at most."""
    if epoch is None:
        return {}
    rows = spark.read.schema("bucket int, written int").parquet(f"{table_path}/manifest/epoch={epoch}").collect()
    return {r.bucket: r.written for r in rows}


def status_sink(stream: DataFrame, table_path: str, keys: list[str], order: list, checkpoint: str, buckets: int = 256) -> StreamingQuery:
    """A status table with the latest record of each unit. Units are dealt to buckets by a hash of their keys; a micro-batch reads
    and writes only the buckets that it touches, below its own number, and then a manifest that names the epoch of each bucket. So
    bytes written follow the batch, a batch that runs again writes the same, and readers see a batch whole or not at all. The
    number of buckets belongs to the table and can't be changed later. status_table() reads it."""
    spark = stream.sparkSession
    own = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    newest = [F.desc(c) for c in order]

    def merge(batch: DataFrame, epoch: int) -> None:
        earlier = [e for e in _epochs(spark, table_path) if e < epoch]
        known = _manifest(spark, table_path, earlier[-1] if earlier else None)
        latest = first_per_key(batch, keys, newest).withColumn("bucket", own).persist()
        touched = [r.bucket for r in latest.select("bucket").distinct().collect()]  # a number each, `buckets` at most
        paths = [f"{table_path}/data/epoch={known[b]}/bucket={b}" for b in touched if b in known]
        now = latest
        if paths:
            before = spark.read.schema(batch.schema).parquet(*paths).withColumn("bucket", own)
            now = first_per_key(latest.unionByName(before), keys, newest)
        now.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table_path}/data/epoch={epoch}")
        written = sorted((known | dict.fromkeys(touched, epoch)).items())
        spark.createDataFrame(written, "bucket int, written int").coalesce(1).write.mode("overwrite").parquet(f"{table_path}/manifest/epoch={epoch}")
        latest.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_table(spark: SparkSession, table_path: str, schema) -> DataFrame:
    """The status table as of its last complete micro-batch; empty before the first."""
    epochs = _epochs(spark, table_path)
    known = _manifest(spark, table_path, epochs[-1] if epochs else None)
    paths = [f"{table_path}/data/epoch={e}/bucket={b}" for b, e in known.items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def progress(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Done and total work, the rate (measured over planned seconds, clamped to 0.5..3) and the remaining seconds; for a stream
    (complete mode) or a table. df: keys, planned_s, actual_s (null if it is not done)."""
    done = F.col("actual_s").isNotNull()
    sums = df.groupBy(*keys).agg(F.count_if(done).alias("n_done"), F.count("*").alias("n_total"), F.sum(F.when(done, F.col("planned_s")).otherwise(0.0)).alias("_planned"), F.sum(F.when(done, F.col("actual_s")).otherwise(0.0)).alias("_actual"), F.sum("planned_s").alias("_all"))
    rate = F.least(F.greatest(F.coalesce(F.try_divide("_actual", "_planned"), F.lit(1.0)), F.lit(0.5)), F.lit(3.0))
    return sums.select(*keys, "n_done", "n_total", rate.alias("rate"), ((F.col("_all") - F.col("_planned")) * rate).alias("remaining_s"))


def sessions(stream: DataFrame, keys: list[str], ts: str = "ts", gap: str = "2 seconds", late: str = "10 seconds", least: int = 5) -> DataFrame:
    """T4: sequences by a session window, closed by the watermark, of least rows or more. A frame number can be turned into a time
    by timestamp_seconds(frame): a gap of g frames is then g seconds; session windows end strictly before the gap, so pass a
    little more than g to keep differences of exactly g together."""
    s = stream.withWatermark(ts, late) if stream.isStreaming else stream
    out = s.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return out.filter(F.col("n") >= least).select(*keys, "n", "first", "last")

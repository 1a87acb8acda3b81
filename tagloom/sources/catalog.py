"""Tables on disk under names, and sinks of tables and results."""

from __future__ import annotations

import hashlib
import tempfile
import time
import uuid
from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F


class Catalog(Mapping):
    """The tables of a directory by name, to be read; ``register`` makes them views for SQL. Tables that were written in
    buckets are read with them, so that a key prunes to its bucket and joins by the key need no exchange."""

    def __init__(self, spark: SparkSession, path: str, names: list[str] | None = None, layout: dict[str, Row] | None = None):
        self.spark, self.path, self._layout = spark, path.rstrip("/"), layout
        self.names = list(self.layout if names is None else names)

    @property
    def layout(self) -> dict[str, Row]:
        """How each table was written last: a row for each table."""
        if self._layout is None:
            rows = self.spark.read.schema(_LAYOUT).parquet(f"{self.path}/{LAYOUT}") if _exists(self.spark, f"{self.path}/{LAYOUT}") else None
            last = rows.groupBy("name").agg(F.max_by(F.struct(*rows.columns), "written").alias("l")).select("l.*").collect() if rows is not None else []
            self._layout = {r.name: r for r in last}
        return self._layout

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        found = self.layout.get(name)
        if found is None or not found.bucket_by:
            return self.spark.read.parquet(f"{self.path}/{name}")
        quoted = ", ".join(f"`{c}`" for c in found.bucket_by)
        table = f"tagloom_{hashlib.sha1(f'{self.path}/{name}'.encode()).hexdigest()[:16]}_{found.written}"
        place = self.path.replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({found.columns}) USING parquet CLUSTERED BY ({quoted}) SORTED BY ({quoted}) INTO {found.buckets} BUCKETS LOCATION '{place}/{name}'"
        )
        return self.spark.table(table)

    def __iter__(self) -> Iterator[str]:
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)

    def register(self) -> None:
        for name in self.names:
            self[name].createOrReplaceTempView(name)


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _exists(spark: SparkSession, path: str) -> bool:
    found, files = _path(spark, path)
    return files.exists(found)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of tables that nothing needs any more."""
    found, files = _path(spark, path)
    files.delete(found, True)


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: below the checkpoint folder of the session, in local mode also elsewhere."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and (current := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        shared = current.get()
    if not shared and spark.sparkContext.master.partition("[")[0] == "local":
        shared = tempfile.gettempdir()
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared.rstrip('/')}/tables-{uuid.uuid4().hex}"


#: Table with the layout of the others, and its columns.
LAYOUT = "table_layout"
_LAYOUT = "name string, columns string, bucket_by array<string>, buckets int, rows long, written long"


def write_table(
    df: DataFrame, path: str, name: str, partition_by: tuple[str, ...] = (), bucket_by: tuple[str, ...] = (), buckets: int = 64, counters: Mapping[str, Column] | None = None
) -> tuple[Row, dict[str, int]]:
    """Writes a table below the path, once; returns its layout and its counters (aggregates over its rows; null counts as 0).

    The counters are observed in the tasks that write, so they cost no pass of their own; these tasks are the last stage of
    the job and a repeated one counts once. In buckets, rows of a key meet in one sorted file.
    """
    spark, columns = df.sparkSession, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    place, seen = f"{path.rstrip('/')}/{name}", Observation()
    df = df.repartition(buckets, *bucket_by) if bucket_by else df
    made = [F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(n) for n, c in (counters or {}).items()]
    writer = df.observe(seen, F.count("*").alias("rows in all"), *made).write.mode("overwrite")
    if bucket_by:  # the name is of no use later: a catalog makes its own
        table = f"tagloom_{uuid.uuid4().hex}"
        writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by).option("path", place).format("parquet").saveAsTable(table)
        spark.sql(f"DROP TABLE {table}")
    else:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(place)
    found = dict(seen.get)
    row = Row(name=name, columns=columns, bucket_by=list(bucket_by), buckets=buckets if bucket_by else None, rows=found.get("rows in all", 0), written=time.time_ns())
    return row, {n: found.get(n, 0) for n in counters or {}}


def write_layout(spark: SparkSession, path: str, rows: list[Row]) -> None:
    """Adds what a catalog has to know of tables that were written: a row for each of them."""
    spark.createDataFrame(rows, _LAYOUT).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/{LAYOUT}")


def write_tables(tables: Mapping[str, DataFrame], path: str, partition_by: Mapping[str, list[str]] | None = None, bucket_by: Mapping[str, list[str]] | None = None, buckets: int = 64) -> None:
    """Writes every table; large ones can be partitioned, or sorted into buckets."""
    rows = [write_table(df, path, n, tuple((partition_by or {}).get(n, ())), tuple((bucket_by or {}).get(n, ())), buckets)[0] for n, df in tables.items()]
    write_layout(next(iter(tables.values())).sparkSession, path, rows)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A result as CSV with a header, columns in the given order."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def result_envelope(page: DataFrame, matching: DataFrame, url: str, data_until: Column | None = None, page_no: int | None = None, rp: int | None = None) -> DataFrame:
    """One row of JSON: url, data_until, page, rp, total (rows before paging) and data. ``page`` is a page of results, so
    its rows fit into one value; whole results are written as JSON lines instead."""
    data = page.agg(F.collect_list(F.struct(*page.columns)).alias("data"))
    total = matching.agg(F.count("*").alias("total"))
    head = [F.lit(url).alias("url"), (F.lit(None).cast("string") if data_until is None else data_until.cast("string")).alias("data_until"), F.lit(page_no).cast("int").alias("page"), F.lit(rp).cast("int").alias("rp")]
    return data.crossJoin(total).select(F.to_json(F.struct(*head, "total", "data"), {"ignoreNullFields": "false"}).alias("value"))


def append_history(stats: DataFrame, path: str, udate: Column) -> None:
    """Today's statistics as a partition of the history; a second run on a day replaces that day's partition only."""
    rows = stats.select("key", "value", udate.cast("date").alias("udate"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("udate").parquet(path)


def metrics(tables: Mapping[str, DataFrame], sources: DataFrame, image_cache: DataFrame, now: Column) -> DataFrame:
    """(metric, label, value): rows of tables, times of sources as epoch seconds, ages of cached images in cumulative
    buckets of ten days, and images by repository."""
    import functools

    frames = [df.agg(F.count("*").cast("double").alias("value")).select(F.lit("table_rows").alias("metric"), F.lit(name).alias("label"), "value") for name, df in tables.items()]
    for column in ("update_start", "update_end", "data_until"):
        frames.append(sources.select(F.lit(f"source_{column}").alias("metric"), F.col("id").alias("label"), F.unix_timestamp(column).cast("double").alias("value")))
    age = image_cache.select(F.datediff(now, "timestamp").alias("age"), "body")
    bounds = [*range(10, 101, 10)]
    one = age.agg(*[F.count_if(F.col("age") <= b).cast("double").alias(f"le{b}") for b in bounds], F.count("*").cast("double").alias("n"), F.coalesce(F.sum("age"), F.lit(0)).cast("double").alias("sum"))
    rows = [("image_age_bucket", str(b), F.col(f"le{b}")) for b in bounds] + [("image_age_bucket", "+Inf", F.col("n")), ("image_age_count", "", F.col("n")), ("image_age_sum", "", F.col("sum"))]
    frames.append(one.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(label).alias("label"), v.alias("value")) for m, label, v in rows]))))
    pages = image_cache.select(F.explode(F.from_json("body", "query struct<pages:map<string,struct<imagerepository:string>>>")["query"]["pages"]).alias("id", "page"))
    frames.append(pages.groupBy(F.coalesce("page.imagerepository", F.lit("")).alias("label")).agg(F.count("*").cast("double").alias("value")).select(F.lit("image_repository").alias("metric"), "label", "value"))
    return functools.reduce(DataFrame.unionByName, frames)

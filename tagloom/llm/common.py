"""What the text operators share: reading tables, cutting lineage, and one map over texts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a folder of our own only in local mode, as one of
    the driver's machine would be out of reach for the executors of a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and (current := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        named = current.get()
    if not named and spark.sparkContext.master.partition("[")[0] == "local":  # one process on one machine, as in tests
        named = tempfile.mkdtemp(prefix="tagloom-")
        spark.sparkContext.setCheckpointDir(named)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named.rstrip("/")


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """The rows as a table in the shared folder, read back: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tagloom-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and that nothing needs any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def measured(df: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(rows, bytes of their texts): numbers of parts follow them, no result does."""
    row = df.agg(F.count("*"), F.sum(F.octet_length(text_col).cast("long"))).first()
    return row[0], row[1] or 0


def hand_back() -> None:
    """Gives the memory that a task no longer uses back to the system, as its worker waits for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


#: Rows of a batch that become Python values at a time.
ROWS = 256


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def struct_of(fn: Callable[[tuple], tuple], schema: str) -> Callable[..., Column]:
    """A function of columns that gives the fields of ``schema``: for where all columns of a row stay beside it.

    Works on Arrow batches; only the columns it is called with reach Python.
    """
    fields = arrow_schema(schema)

    def rows(columns: list) -> pa.StructArray:
        parts = []
        for at in range(0, max(1, len(columns[0])), ROWS):
            made = list(zip(*(fn(*row) for row in zip(*(c.slice(at, ROWS).to_pylist() for c in columns)))))
            made = made or [[]] * len(fields)
            parts.append(pa.StructArray.from_arrays([pa.array(list(v), f.type) for v, f in zip(made, fields)], fields=list(fields)))
        hand_back()
        return pa.concat_arrays(parts)

    def one(a: pa.Array) -> pa.Array:
        return rows([a])

    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return rows([a, b, c])

    calls = {1: F.arrow_udf(one, schema), 3: F.arrow_udf(three, schema)}
    return lambda *columns: calls[len(columns)](*columns)


def map_texts(
    df: DataFrame,
    columns: list[str],
    fn: Callable[[tuple], tuple],
    schema: str,
    rows_per_batch: int = ROWS,
) -> DataFrame:
    """One output row for each input row: ``fn`` gets the named columns and returns the columns of ``schema``.

    Only the named columns reach Python, so further columns (whatever their names) are neither read nor carried.
    Batches are cut to ``rows_per_batch`` rows so that memory follows the texts in hand, not the partition.
    """
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, rows_per_batch):
                part = whole.slice(start, rows_per_batch)
                rows = [fn(*row) for row in zip(*(c.to_pylist() for c in part.columns))]
                made = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(v), type=f.type) for v, f in zip(made, arrow)], schema=arrow
                )
        hand_back()

    return df.select(*columns).mapInArrow(run, schema)


#: A space between two white-space characters, or after one at the end: there the pieces depend on both sides.
UNCLEAR = re.compile(r" (?<=\s )(?=\s|\Z)")


def chunks(text: str | None, find: Callable[[str], list[str]]) -> tuple[list[str], list[str]]:
    """The pieces of a text before its first cut, and the chunks after each cut.

    With the splitting pattern of byte-level vocabularies a space before a visible character always starts a piece, so a
    text may be cut before its single spaces, and equal chunks are split once (``chunk_pieces``).
    """
    if not text:
        return [], []
    if UNCLEAR.search(text):
        return find(text), []
    first, *rest = text.split(" ")
    return find(first), rest


def chunk_pieces(chunk: str, find: Callable[[str], list[str]]) -> list[str]:
    """The pieces of a chunk with the space before it."""
    return [" " + chunk] if chunk.isascii() and chunk.isalpha() else find(" " + chunk)  # letters are one piece


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

"""What the operators share around Spark: the folder for written tables, and input columns."""

from __future__ import annotations

import tempfile
import uuid
from typing import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import blocks


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """The columns an operator reads, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def fresh(taken: list[str], *names: str) -> list[str]:
    """These names, with as many underscores after each as keep it apart from the taken ones."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name in used:
            name += "_"
        used.add(name)
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """The frame's columns, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. A session without it gets one of its own if it has no other machines (tests); on a cluster that's an error, for each machine would write to its own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir isn't set, and executors of {master} share no other folder")
        base = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, **options: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage ends there, and lost executors don't lose it."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes a table made by `written` that nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def appended(docs: DataFrame, f: Callable[[pa.RecordBatch], list[pa.Array]], added: list[StructField]) -> DataFrame:
    """docs with all of its columns and those that f makes from blocks of (doc_id, text)."""
    own = fresh(docs.columns, "id", "text")
    wide = docs.select(*columns_of(docs), F.col("doc_id").cast("long").alias(own[0]), F.col("text").cast("string").alias(own[1])) if dict(docs.dtypes)["text"] != "string" or dict(docs.dtypes)["doc_id"] != "bigint" else docs
    id_at, text_at = (len(docs.columns), len(docs.columns) + 1) if wide is not docs else (docs.columns.index("doc_id"), docs.columns.index("text"))
    names = [*docs.columns, *(a.name for a in added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.blocks(batch, batch.schema.names[text_at]):
                pair = pa.RecordBatch.from_arrays([part.column(id_at), part.column(text_at)], ["doc_id", "text"])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names) - len(added)], *f(pair)], names)

    return wide.mapInArrow(run, StructType([*docs.schema.fields, *added]))


def per_block(f: Callable[[pa.RecordBatch], pa.RecordBatch | None], size: int = blocks.BLOCK_BYTES):
    """A function for mapInArrow that gives f bounded slices of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.blocks(batch, size=size):
                out = f(part)
                if out is not None and out.num_rows:
                    yield out

    return run

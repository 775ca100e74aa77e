"""Session helpers shared by the operators: table access, the shared folder, stored tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.llm.words import blocks

REPO = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package although their working folder is another one, and keep
    what is sent to them at once small: texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, on one machine, a temporary one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pagelens-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/pagelens/{label}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def named(column: str):
    """The column of this name, whatever characters the name holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def free_name(columns: list[str], wanted: str) -> str:
    """`wanted`, with as many underscores in front as it takes to be no name of these, however written."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def with_results(docs: DataFrame, keep: list[str], column: str, made: list[tuple[str, T.DataType]], run: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]]) -> DataFrame:
    """The `keep` columns of every row and the columns `made` by run(), which gets blocks whose last column is `column` and gives
    lists of arrays, the kept ones first. Names may be any: the tasks see numbers."""
    rows = docs.select(*[named(c).alias(f"c{k}") for k, c in enumerate(keep)], named(column).alias("t"))
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(f"m{k}", t) for k, (_, t) in enumerate(made))])
    names = schema.fieldNames()

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrays in run(blocks(batches, "t")):
            yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(in_task, schema).toDF(*keep, *(name for name, _ in made))


def crc_mod(column: str, modulus: int):
    """crc32 of the id as text, modulo `modulus`; null ids count as remainder 0 of the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))

"""Tables written to the folder that driver and executors share, and the sinks of an audit."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; where neither is set (one machine, tests) one is made."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    jsc = sc._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pagelens-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet and read again: cuts lineage, and what is lost with an executor is read again, not made again."""
    path = f"{shared_dir(df.sparkSession)}/pagelens/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def portfolio_path(root: str, user: str) -> str:
    """Where the tables of one user's portfolio lie."""
    if not user or "/" in user or user in (".", ".."):
        raise ValueError(f"not a user's name: {user!r}")
    return f"{root.rstrip('/')}/{user}/portfolio"


def save_portfolio(tables: dict[str, DataFrame], root: str, user: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{portfolio_path(root, user)}/{name}")


def load_portfolio(spark: SparkSession, root: str, user: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{portfolio_path(root, user)}/{name}") for name in names}


def insert_new(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are not known yet, one for each key: what an insert-or-ignore adds."""
    return rows.join(known.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)


def replace_findings(found: DataFrame, folder: str) -> None:
    """Writes findings by run and site; a second analysis of a site replaces its rows and no others."""
    found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "site_id").parquet(folder)

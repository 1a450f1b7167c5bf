"""Plumbing shared by the operators: shared-folder tables, fresh column names, input hygiene."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare

_written: list[tuple[SparkSession, str]] = []
_kept: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: the lineage ends in files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._textloom_path = path
    return back


FLOOR = 100_000  # rows of one key that any task can hold


def spread_join(rows: DataFrame, totals: DataFrame, key: str, total: int, most: int = 10_000) -> DataFrame:
    """rows joined with totals (key, n, ..), where n is the number of rows of each key and total that of all.

    A key that has over 1/most of all rows (and over FLOOR) is joined by a broadcast of such keys, of which there can't be more than most, so its rows stay where
    they are; the others are shuffled, and no task gets more than that share for one key.  rows and totals are read twice: written tables are best."""
    bound = max(FLOOR, total // most)
    if total <= bound:
        return rows.join(totals, key)
    hot, cold = F.broadcast(totals.where(F.col("n") > bound)), totals.where(F.col("n") <= bound)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def discard(*dfs: DataFrame | None) -> None:
    """Deletes tables of materialize() that no later plan reads."""
    for df in dfs:
        path = getattr(df, "_textloom_path", None)
        if path:
            _delete(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


def discard_all() -> None:
    """Deletes every table that materialize() has written in this session, when its results are saved."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended before
            return


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder that no later plan reads."""
    _delete(spark, path)


def until_exit(spark: SparkSession, path: str) -> None:
    """Has a result's folder deleted when the program ends, not before: a caller may still read it."""
    _kept.append((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _at_exit() -> None:
    _written.extend(_kept)
    discard_all()


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df lacks, whatever the case."""
    have = {c.lower() for c in df.columns}
    out = []
    for s in stems:
        name = f"__{s}"
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def own(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: whatever else the table has can't clash with an operator's own columns."""
    return df.select(*[F.col(f"`{n}`") for n in names])

"""The index of a corpus: what is derived from its texts is written once, as tables, and read by every operator after.

A table of documents with an index attached (`attach`, `load`) answers `headings(docs)`, `term_freq(docs)` and
the like from the folder; any other table of documents, such as a filtered one, derives them anew.
"""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 6
#: Every table of an index, in the order in which one reads another.
TABLES = ("headings", "links", "adr_refs", "spans", "sections", "term_freq", "doc_length", "keyword_sets", "postings", "resolved_links", "edges", "doc_metrics", "section_metrics", "simhash", "minhash", "section_fingerprints")
#: Tables of a row for each document, of which some of TABLES are another layout (`view`): an index holds these, and those are answered from them.
ROWS = ("doc_words", "fingerprints")
#: What an index may lack: its readers get no rows.
OPTIONAL = {"edges": "source string, target string, kind string, anchor string, src_heading string, src_line int, tgt_heading string, tgt_line int, raw_text string"}
#: Small row groups: a table whose input was one large file is read by many tasks all the same.
SPLIT = {"parquet.block.size": 4 << 20}
_makers: dict[str, Callable[[DataFrame], DataFrame]] = {}
_views: set[str] = set()
_folders: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


class Index:
    """A folder of tables; a lazy one writes a table when it is first read."""

    def __init__(self, spark: SparkSession, folder: str, lazy: bool):
        self.spark, self.folder, self.lazy = spark, folder.rstrip("/"), lazy

    def table(self, name: str, docs: DataFrame | None = None) -> DataFrame:
        """What is only another layout of a table isn't written: it's answered from that."""
        at = f"{self.folder}/{name}"
        if not exists(self.spark, f"{at}/_SUCCESS"):
            if name in _views:
                return _makers[name](docs)
            if not self.lazy:
                if name in OPTIONAL:
                    return self.spark.createDataFrame([], OPTIONAL[name])
                raise FileNotFoundError(f"the index in {self.folder} has no table {name}: build it again")
            _makers[name](docs).write.mode("overwrite").options(**SPLIT).parquet(at)
        return self.spark.read.parquet(at)


def view(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A projection of a stored table: an index answers it from that."""
    _views.add(f.__name__)
    return stored(f)


def stored(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """f(docs) from the index of docs, if it has one."""
    _makers[f.__name__] = f

    @functools.wraps(f)
    def run(docs: DataFrame) -> DataFrame:
        index = getattr(docs, "_textloom_index", None)
        return f(docs) if index is None else index.table(f.__name__, docs)

    return run


def derive(name: str, docs: DataFrame) -> DataFrame:
    """A table of TABLES, from the texts."""
    return _makers[name](docs)


def attach(docs: DataFrame, index: Index) -> DataFrame:
    docs._textloom_index = index
    return docs


def build(docs: DataFrame, folder: str, indexed_at: int = 0, source_root: str = "") -> DataFrame:
    """Writes the whole index of docs (path, content, ..) and returns the documents with it; an index that is there is replaced.

    indexed_at (seconds) is a parameter, so that the same corpus gives the same index."""
    spark = docs.sparkSession
    delete(spark, folder)
    docs.write.options(**SPLIT).parquet(f"{folder}/docs")
    known = attach(spark.read.parquet(f"{folder}/docs"), Index(spark, folder, True))
    for name in (*ROWS, *TABLES):
        if name not in _views:
            known._textloom_index.table(name, known)
    about = known.agg(F.count("*").alias("n_docs")).select("n_docs", F.lit(indexed_at).cast("long").alias("indexed_at"), F.lit(VERSION).alias("version"), F.lit(source_root).alias("source_root"))
    about.write.parquet(f"{folder}/about")
    return load(spark, folder)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of an index, with it attached; an error where there is none."""
    if not exists(spark, f"{folder}/docs/_SUCCESS"):
        raise FileNotFoundError(f"no index in {folder}: build it first")
    return attach(spark.read.parquet(f"{folder}/docs"), Index(spark, folder, False))


def about(docs: DataFrame) -> dict:
    return docs._textloom_index.table("about").first().asDict()


def indexed(docs: DataFrame, name: str) -> DataFrame:
    """docs with a lazy index in the shared folder, that lives as long as the session: each table is written when a query first reads it."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/textloom-index-{uuid.uuid5(uuid.NAMESPACE_URL, name)}-{spark.sparkContext.applicationId}"
    if not exists(spark, f"{folder}/docs/_SUCCESS"):
        docs.write.mode("overwrite").options(**SPLIT).parquet(f"{folder}/docs")
        _folders.append((spark, folder))
    return attach(spark.read.parquet(f"{folder}/docs"), Index(spark, folder, True))


def temporary(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: the lineage ends in files that outlive executors and are deleted when the session ends."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/textloom-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    _folders.append((spark, folder))
    return spark.read.schema(df.schema).parquet(folder)


@atexit.register
def _forget() -> None:
    for spark, folder in _folders:
        try:
            delete(spark, folder)
        except Exception:  # noqa: BLE001 - the session may have ended before
            return

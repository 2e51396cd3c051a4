"""Tables in, tables in the shared folder, row keys."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Column that identifies a row inside an operator; no input column has this name.
ROW = "__row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only local mode may go without: it then gets a
    temporary folder for the rest of the session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="crmkiln-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Folders of the tables that were saved since the innermost ``scratch`` of this thread began.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are saved inside go at its end, but for those to keep. Frames made from the others must not be read later."""
    token = _written.set([])
    try:
        yield
    finally:
        paths = _written.get()
        _written.reset(token)
        for path in paths:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def saved(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write the frame to the shared folder and read it back: lineage ends here, and an executor
    that is lost later costs none of this work. ``keep``: also after the ``scratch`` it is in."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _written.get() is not None and not keep:
        _written.get().append(path)
    df.write.option("compression", "zstd").parquet(path)
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of finished plans, so that Spark's cleaner removes their shuffle files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def in_ranges(rows: DataFrame, order: list, last: str) -> DataFrame:
    """Rows in the order of some small keys, equal ones by the column ``last``. Spark samples the keys
    of ranges to the driver, so texts are not among them."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order, F.col(last).asc_nulls_first())


def keyed(docs: DataFrame, keep=()) -> DataFrame:
    """``doc_id``, ``text``, the columns to keep, and a unique row key whose order is that of ``doc_id``.

    Where ``doc_id`` is unique and never null it is the key itself. Else rows are numbered by
    (doc_id, a hash of the text, text), null ids last: repeated rows are documents of their own, one after the other.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       *[name for name in keep if name not in ("doc_id", "text")])
    odd = rows.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1")
    if odd.isEmpty():
        return rows.withColumn(ROW, F.col("doc_id"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("__hash")]
    hashed = rows.withColumn("__hash", F.xxhash64("text"))
    ordered = in_ranges(hashed, order, "text").drop("__hash")
    return saved(ordered.withColumn(ROW, F.monotonically_increasing_id()), "keyed")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every end of the edges (``a``, ``b``).

    Each turn takes the smallest label among neighbours, then the label's own label; labels are
    written tables, and turns end when none changes.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.col("node"), F.min("b")).alias("component")), "components")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(
            F.min("component").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        heads = labels.select(F.col("node").alias("head"), F.col("component").alias("head_component"))
        moved = saved(lower.join(heads, lower["component"] == heads["head"]).select(
            "node", "old", F.least("component", "head_component").alias("component")), "components")
        labels = moved.drop("old")
        if moved.where("old <> component").isEmpty():
            return labels

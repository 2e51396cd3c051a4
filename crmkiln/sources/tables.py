"""Parquet layers: one ``<name>.parquet`` per table under raw/, processed/, summaries/, aggregated/.

What a run builds is a version of its own, ``<root>/versions/<version>``. It is served from the moment that an
empty file ``<root>/published/<number>.<version>`` exists; until then, and where a run fails, the version before
it is served whole. Numbers are handed out when a run publishes, one after the other: a run claims the next one by
creating ``<root>/claims/<number>``, which only one can. The run that ends last is served, whenever it started.
"""

from __future__ import annotations

import hashlib
import tempfile
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType, TimestampNTZType

from crmkiln import schemas

RAW, PROCESSED, SUMMARIES, AGGREGATED = "raw", "processed", "summaries", "aggregated"


@dataclass(frozen=True)
class WriteReport:
    """Row count and elapsed time of one written table."""

    layer: str
    name: str
    rows: int
    seconds: float


def table_path(root: str, layer: str, name: str) -> str:
    return f"{root.rstrip('/')}/{layer}/{name}.parquet"


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _folder(spark, path)
    return files.exists(place)


def work_directory(spark: SparkSession, purpose: str) -> str:
    """A fresh folder in the shared storage the session names in ``spark.checkpoint.dir``. Without
    that setting, local mode names a temporary folder there; on a cluster it would not be shared."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        root = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def _names(spark: SparkSession, path: str) -> list[str]:
    files, place = _folder(spark, path)
    if not files.exists(place):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(place))


def _published(spark: SparkSession, root: str) -> list[str]:
    """Names of published files, in the order of publication."""
    return _names(spark, f"{root.rstrip('/')}/published")


def _version_of(published_name: str) -> str:
    # Without a number of its own where a former release published it: those are ordered by the version's time.
    return published_name.rpartition(".")[2]


def _number_of(name: str) -> int:
    return int(name.partition(".")[0].partition("-")[0])


def new_version(spark: SparkSession, root: str) -> str:
    """A folder for a run to build its layers in; its name begins with the time the run starts."""
    return f"{root.rstrip('/')}/versions/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def published(spark: SparkSession, root: str) -> str:
    """Where the layers lie that are served now: the last published version, or the root itself."""
    names = _published(spark, root)
    return f"{root.rstrip('/')}/versions/{_version_of(names[-1])}" if names else root


def _create(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False where another run has created it."""
    files, place = _folder(spark, path)
    try:
        files.create(place, False).close()
        return True
    except Py4JJavaError:
        if files.exists(place):
            return False
        raise


def _claim(spark: SparkSession, root: str) -> str:
    """The next number of publication; no two runs get the same."""
    while True:
        taken = _names(spark, f"{root}/claims") + _published(spark, root)
        number = f"{max(map(_number_of, taken), default=0) + 1:020d}"
        if _create(spark, f"{root}/claims/{number}"):
            return number


@dataclass(frozen=True)
class Holding:
    """Where the tables of an entity lie, and the fingerprint of what they were built from."""

    fingerprint: str
    holder: str


def fingerprint(spark: SparkSession, path: str, rules: str) -> str | None:
    """A hash of paths, sizes and times of all files of a table, and of the rules that are applied to them; None where
    there is no table. No file is opened; Spark lists large tables in its tasks, and sums hashes of files."""
    if not exists(spark, path):
        return None
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    of_file = "xxhash64({0}, path, length, modificationTime)"
    sums = [f"sum(CAST({of_file.format(seed)} AS DECIMAL(38, 0)))" for seed in (1, 2)]
    found = files.selectExpr("path", "length", "modificationTime").agg(
        F.count(F.lit(1)), F.sum("length"), *map(F.expr, sums)).first()
    return hashlib.sha256(f"{rules} {tuple(found)}".encode()).hexdigest()


def hold(spark: SparkSession, version: str, entity: str, holding: Holding) -> None:
    """Note in a version where the tables of an entity lie."""
    _create(spark, f"{version}/entities/{entity}.{holding.fingerprint}.{holding.holder}")


def holdings(spark: SparkSession, version: str) -> dict[str, Holding]:
    """What is noted in a version; nothing in those of former releases, which hold all of their tables."""
    notes = [name.split(".") for name in _names(spark, f"{version}/entities")]
    return {entity: Holding(mark, holder) for entity, mark, holder in notes}


def holder_path(spark: SparkSession, root: str, version: str, entity: str) -> str:
    """The folder whose layers have the tables of an entity in a version."""
    held = holdings(spark, version).get(entity)
    return f"{root.rstrip('/')}/versions/{held.holder}" if held else version


def publish(spark: SparkSession, root: str, version: str, abandoned_after: float = 7 * 86400) -> None:
    """Serve a version from now on, and remove what is not needed any more: published versions before the last two
    (readers of the previous one may still be at work), their claims, and versions never published whose
    run started more than ``abandoned_after`` seconds ago, as runs that were killed leave them. What a version that
    stays refers to stays as well. A version that refers to one that is gone is not published."""
    root = root.rstrip("/")
    name = version.rstrip("/").rsplit("/", 1)[-1]
    gone = [held.holder for held in holdings(spark, version).values()
            if held.holder != name and not exists(spark, f"{root}/versions/{held.holder}")]
    if gone:
        raise FileNotFoundError(f"versions that {name} refers to are gone: {', '.join(sorted(gone))}")
    _create(spark, f"{root}/published/{_claim(spark, root)}.{name}")
    served = _published(spark, root)
    for old in served[:-2]:
        remove(spark, f"{root}/published/{old}")
    for claim in _names(spark, f"{root}/claims"):
        if _number_of(claim) < _number_of(served[-1]):
            remove(spark, f"{root}/claims/{claim}")
    oldest = time.time_ns() - int(abandoned_after * 1e9)
    dropped = {_version_of(old) for old in served[:-2]}
    found = _names(spark, f"{root}/versions")
    # A version that only others refer to is not published any more; its notes say so after those are gone.
    dropped |= {entry for entry in found if exists(spark, f"{root}/versions/{entry}/retired")}
    kept = {_version_of(entry) for entry in served[-2:]}
    kept |= {entry for entry in found if entry not in dropped and _number_of(entry) >= oldest}
    kept |= {held.holder for entry in kept for held in holdings(spark, f"{root}/versions/{entry}").values()}
    for entry in found:
        if entry not in kept:
            remove(spark, f"{root}/versions/{entry}")
        elif entry in dropped:
            _create(spark, f"{root}/versions/{entry}/retired")


def remove(spark: SparkSession, path: str) -> None:
    files, place = _folder(spark, path)
    files.delete(place, True)


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at the path, or None where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def load(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at the path, or an empty one of the given schema."""
    found = read_if_present(spark, path)
    return spark.createDataFrame([], schema) if found is None else found


def _conform(field: StructField, found: StructField) -> Column:
    column = F.col(found.name)
    if isinstance(field.dataType, DoubleType):
        # NaN stands for a missing number in files written by NumPy-based tools.
        number = column.cast("double")
        column = F.when(~F.isnan(number), number)
    elif isinstance(field.dataType, TimestampNTZType) and isinstance(found.dataType, LongType):
        # Nanoseconds since the epoch (see spark.sql.legacy.parquet.nanosAsLong).
        micros = F.expr(f"(`{found.name}` - pmod(`{found.name}`, 1000)) div 1000")
        column = F.timestamp_micros(micros).cast("timestamp_ntz")
    elif found.dataType != field.dataType:
        column = column.cast(field.dataType)
    return column.alias(field.name)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Bring an entity table to its schema. A missing column is an error; extra ones are kept."""
    found = {field.name: field for field in df.schema.fields}
    missing = [field.name for field in schema.fields if field.name not in found]
    if missing:
        raise ValueError(f"columns missing from input: {', '.join(missing)}")
    known = {field.name for field in schema.fields}
    return df.select(
        *[_conform(field, found[field.name]) for field in schema.fields],
        *[F.col(f"`{name}`") for name in found if name not in known],
    )


def read_entity(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """A raw entity table in its schema, or None where the input is absent."""
    df = read_if_present(spark, table_path(root, RAW, name))
    return None if df is None else conform(df, schemas.RAW[name])


def write_table(df: DataFrame, root: str, layer: str, name: str) -> WriteReport:
    """Overwrite one table (Snappy Parquet) and count its rows on the way, without a second pass."""
    started = time.monotonic()
    seen = Observation(f"{layer}_{name}")
    (
        df.observe(seen, F.count(F.lit(1)).alias("rows"))
        .write.mode("overwrite")
        .option("compression", "snappy")
        .parquet(table_path(root, layer, name))
    )
    return WriteReport(layer, name, seen.get["rows"], time.monotonic() - started)


def write_raw(entities: dict[str, DataFrame], root: str) -> list[WriteReport]:
    """Write raw entity tables."""
    return [write_table(df, root, RAW, name) for name, df in entities.items()]

"""What every operator needs from the session: lineage cuts, shipping of the package, counting rows."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_OWN: dict[str, str] = {}
_FOLDERS: dict[str, str] = {}


def session(app: str = "weftline", master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the settings the engine is tested with; a cluster brings its own."""
    builder = SparkSession.builder.appName(app).master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); one of our own only where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="weftline-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        at = "file://" + _OWN[app]
    return at.rstrip("/")


def _folder(spark: SparkSession) -> str:
    """The folder of this application's tables, deleted when Python ends."""
    app = spark.sparkContext.applicationId
    at = f"{shared_dir(spark)}/weftline-{app}"
    if app not in _FOLDERS:
        _FOLDERS[app] = at
        atexit.register(_swept, spark, at)
    return at


def _swept(spark: SparkSession, at: str) -> None:
    try:
        _deleted(spark, at)
    except Exception:  # noqa: BLE001 - the session is gone; its folder is the cluster's to clean
        pass


def _deleted(spark: SparkSession, at: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Cut:
    """A table written to the shared folder: ends the lineage and survives the loss of executors."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{_folder(self.spark)}/{uuid.uuid4().hex}"
        self.schema = df.schema
        df.write.parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only once nothing lazy still reads them."""
        _deleted(self.spark, self.path)


def cut(df: DataFrame) -> DataFrame:
    return Cut(df).df


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    to = os.path.join(tempfile.mkdtemp(prefix="weftline-"), "weftline.zip")
    atexit.register(shutil.rmtree, os.path.dirname(to), ignore_errors=True)
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path("weftline") / p.relative_to(root)))
    spark.sparkContext.addPyFile(to)
    _SHIPPED.add(app)


def newest(df: DataFrame, keys: list[str], order: str, tie: list[str] | None = None) -> DataFrame:
    """The row that counts for each key: the one latest by ``order``.

    Rows with a null key are dropped (they cannot be told apart); a null ``order`` is oldest; ties are broken by a hash
    of the columns ``tie`` (default: all others), so the result does not depend on the partitioning. Who reads different
    columns of one table should give the same ``tie`` everywhere, or else equal rows may be told apart differently. Spark limits each group before the shuffle,
    so a key with very many rows stays small.
    """
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    rest = [c for c in df.columns if c not in (*keys, order)]
    rest = rest if tie is None else tie
    mark: Column = F.xxhash64(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(0)
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), mark)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")

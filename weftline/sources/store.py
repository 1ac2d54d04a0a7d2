"""Tables of an engine directory: replaced whole, merged by key, and a small key-value table."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_env(path: str) -> dict[str, str]:
    """Settings of a file of lines NAME=value; blank lines and comments are skipped, a missing file has none."""
    out: dict[str, str] = {}
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            for line in map(str.strip, f):
                name, equals, value = line.removeprefix("export ").partition("=")
                if equals and not line.startswith("#"):
                    out[name.strip()] = value.strip().strip("'\"")
    return out


@dataclass
class Store:
    """Parquet tables under ``root``, each written to a new folder and then made current by one small rename.

    A reader sees the old table or the new, never a part; a failed write leaves the old one. The version before is kept
    for readers that hold it, until the next replacement.
    """

    spark: SparkSession
    root: str

    @classmethod
    def from_env(cls, spark: SparkSession) -> Store:
        root = os.environ.get("WEFTLINE_ROOT") or read_env(".env").get("WEFTLINE_ROOT")
        if not root:
            raise RuntimeError("WEFTLINE_ROOT is not set: export WEFTLINE_ROOT=/path/to/the/engine's/tables, or put it into .env")
        return cls(spark, root)

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _current(self, name: str) -> str | None:
        fs, path = self._fs()
        at = path(f"{self.root}/{name}/CURRENT")
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        return self._current(name) is not None

    def read(self, name: str) -> DataFrame:
        version = self._current(name)
        if version is None:
            raise RuntimeError(f"no table {name} in {self.root}")
        return self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def replace(self, name: str, df: DataFrame) -> None:
        """The whole table; an empty frame empties it."""
        fs, path = self._fs()
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/{name}/{version}")
        old = self._current(name)
        new = fs.makeQualified(path(f"{self.root}/{name}/CURRENT.{version}"))
        stream = fs.create(new)
        stream.write(bytearray(version.encode()))
        stream.close()
        # A rename that replaces its target in one step: there is always a current table.
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        how = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        over = gateway.new_array(how, 1)
        over[0] = how.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(new, fs.makeQualified(path(f"{self.root}/{name}/CURRENT")), over)
        for at in fs.listStatus(path(f"{self.root}/{name}")):
            if at.isDirectory() and at.getPath().getName() not in (version, old):
                fs.delete(at.getPath(), True)

    def upsert(self, name: str, df: DataFrame, key: str) -> None:
        """Rows with a known key replace the columns they have; others are added; columns only stored are kept."""
        if not self.exists(name):
            return self.replace(name, df)
        old = self.read(name)
        both = old.withColumn("__old", F.lit(True)).alias("o").join(df.withColumn("__new", F.lit(True)).alias("n"), key, "full")
        cols = [F.col(key)]
        for c in dict.fromkeys([*old.columns, *df.columns]):
            if c == key:
                continue
            o = F.col(f"o.{c}") if c in old.columns else F.lit(None)
            cols.append((F.when(F.col("__new"), F.col(f"n.{c}")).otherwise(o) if c in df.columns else o).alias(c))
        self.replace(name, both.select(*cols))

    def get(self, key: str) -> str | None:
        if not self.exists("meta"):
            return None
        row = self.read("meta").filter(F.col("key") == key).first()
        return row.value if row else None

    def set(self, key: str, value: object) -> None:
        self.upsert("meta", self.spark.createDataFrame([(key, str(value))], "key string, value string"), "key")


def health(store: Store, tables: list[str] = ("cards", "tags", "meta")) -> tuple[list[tuple[str, bool, str]], int]:
    """Rows (check, passed, detail) and an exit code; an unreachable store skips what depends on it."""
    rows: list[tuple[str, bool, str]] = []
    try:
        fs, path = store._fs()
        there = fs.exists(path(store.root))
        rows.append(("Connectivity", there, store.root if there else f"no folder {store.root}"))
    except Exception as e:  # noqa: BLE001 - any failure to reach it is the finding
        rows.append(("Connectivity", False, str(e).split("\n")[0]))
    if not rows[0][1]:
        return [*rows, *((t, False, "SKIP") for t in ("Database", "Lookups", *(f"Table {t}" for t in tables)))], 1
    try:
        held = sorted(x.getPath().getName() for x in fs.listStatus(path(store.root)) if x.isDirectory())
        rows.append(("Database", True, f"{len(held)} table(s) in {store.root}"))
    except Exception as e:  # noqa: BLE001
        rows.append(("Database", False, str(e).split("\n")[0]))
    try:  # what an index would serve: lookups by name and by oracle id
        lacks = [c for c in ("names", "oracle_id") if c not in store.read("cards").columns]
        rows.append(("Lookups", not lacks, f"missing: {', '.join(lacks)}" if lacks else "names, oracle_id on cards"))
    except Exception as e:  # noqa: BLE001
        rows.append(("Lookups", False, str(e).split("\n")[0]))
    for t in tables:
        try:
            rows.append((f"Table {t}", True, str(store.read(t).count())))
        except Exception as e:  # noqa: BLE001
            rows.append((f"Table {t}", False, str(e).split("\n")[0]))
    return rows, int(not all(ok for _, ok, _ in rows))

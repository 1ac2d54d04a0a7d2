"""Bulk files, lists and exports."""

from __future__ import annotations

import gzip
import io
import json
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CARD_BULK = """id string, oracle_id string, name string, mana_cost string, type_line string, oracle_text string,
keywords array<string>, colors array<string>, color_identity array<string>, cmc double, power string, toughness string,
card_faces array<struct<name:string,mana_cost:string,type_line:string,oracle_text:string>>"""
TAG_BULK = """id string, slug string, label string, type string, description string, parent_ids array<string>,
child_ids array<string>, aliases array<string>, taggings array<struct<oracle_id:string,weight:string,annotation:string>>"""
SIGNAL_PAYLOAD = """container struct<json_dict:struct<cardlists:array<struct<header:string,tag:string,cardviews:array<struct<
id:string,name:string,lift:double,synergy:double,num_decks:bigint,potential_decks:bigint,trend_zscore:double>>>>>>"""


def bulk_entry(catalogue: DataFrame, kind: str) -> DataFrame:
    """The first entry of a kind in a catalogue of bulk files (type, download_uri, updated_at); an error if none is."""
    hit = catalogue.filter(F.col("type") == kind).coalesce(1).limit(1)
    if hit.isEmpty():
        raise RuntimeError(f"the catalogue has no entry of type {kind}")
    return hit


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, broken ones an error.

    Spark unpacks by name (.gz); files that are packed under another name, as their first two bytes tell, are unpacked
    as streams, each in one task, as a packed file is in any case.
    """
    odd = [at for at in _files(spark, path) if not at.endswith(".gz") and _packed(spark, at)]
    if not odd:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    plain = [at for at in _files(spark, path) if at not in odd]
    lines = spark.read.format("binaryFile").load(odd).select("content").mapInArrow(_unpacked, "value string")
    every = lines.unionByName(spark.read.text(plain)) if plain else lines
    each = every.filter(F.trim("value") != "").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x"))
    return each.select("x.*")


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files that a path, which may be a folder or a pattern, stands for."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for s in fs.globStatus(at) or []:
        out += [x.getPath().toString() for x in (fs.listStatus(s.getPath()) if s.isDirectory() else [s]) if x.isFile() and not x.getPath().getName().startswith(("_", "."))]
    return out


def _packed(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return (stream.read(), stream.read()) == (0x1F, 0x8B)
    finally:
        stream.close()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column(0):
            with gzip.open(io.BytesIO(content.as_buffer()), "rt", encoding="utf-8") as f:
                while some := list(islice(f, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array([x.rstrip("\r\n") for x in some], pa.string())], names=["value"])


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(slug, payload) of whole JSON files, one for each commander; the slug is the file's name."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("slug"), F.col("value").alias("raw"))
    return raw.select("slug", F.from_json("raw", SIGNAL_PAYLOAD, {"mode": "FAILFAST"}).alias("payload"))


def list_lines(spark: SparkSession, path: str | None, more: list[str] = ()) -> DataFrame:
    """(src, pos, line) of a text file, then of further lines; lines are numbered within their source."""
    extra = spark.createDataFrame([(1, i, x) for i, x in enumerate(more)], "src int, pos long, line string")
    if path is None:
        return extra
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    return whole.select(F.lit(0).alias("src"), F.col("pos").cast("long"), "line").unionByName(extra)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", "false").json(path)


def export_json(hits: DataFrame, key: str, path: str, fields: list[str]) -> int:
    """One sorted, indented JSON object, from each asked name to a list of its records; returns the names without any.

    Meant for the subset a person asks for by name: a row for each name comes to the driver.
    """
    rows = hits.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col(fields[0]).isNotNull(), F.struct(*fields)))).alias("found")).collect()
    out = {r[key]: [x.asDict() for x in r.found] for r in rows}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(out, indent=2, sort_keys=True, ensure_ascii=False), encoding="utf-8")
    return sum(not v for v in out.values())

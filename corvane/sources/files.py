"""Files in and out: manifests with checksums, delimited files, JSON lines, Markdown tables, snapshots."""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corvane.functions.text import is_blank

PAIR_COLUMNS = ["DDInterID_A", "DDInterID_B", "Drug_A", "Drug_B", "Level"]
# States of a query after which it is asked again.
TRANSIENT = (0, 429, 500, 502, 503, 504)


def node_file(spark: SparkSession, path: str) -> DataFrame:
    """A TSV of nodes with a header; of rows with one id the last counts."""
    n = spark.read.csv(path, sep="\t", header=True, schema="id string, name string, kind string").withColumn("at", F.monotonically_increasing_id())
    return n.groupBy("id").agg(F.max_by(F.struct("name", "kind"), "at").alias("x")).select("id", "x.name", "x.kind")


def edge_file(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A TSV of edges, which may be gzipped; such a file can't be read in parts, so its rows are spread after reading."""
    e = spark.read.csv(path, sep="\t", header=True, schema="source string, metaedge string, target string")
    return e.repartition(partitions or spark.sparkContext.defaultParallelism) if path.endswith(".gz") else e


def graph_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, all strings; nulls are empty strings, as in the stored graph."""
    return spark.read.csv(path, header=True, schema=schema).na.fill("")


def strict_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Distinct nodes and edges, with counts; raises where a value is blank."""
    for df in (nodes, edges):
        bad = df.filter(" or ".join(f"trim(coalesce({c}, '')) = ''" for c in df.columns)).count()
        if bad:
            raise ValueError(f"{bad} rows with blank values in {df.columns}")
    trim = lambda df: df.select(*[F.trim(c).alias(c) for c in df.columns])
    first = Window.partitionBy("id").orderBy("name", "kind")
    n = trim(nodes).withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k")
    e = trim(edges).distinct()
    return n, e, {"nodes": n.count(), "edges": e.count()}


def manifest(path: str) -> dict:
    m = json.loads(Path(path).read_text())
    missing = {"dataset", "download_page", "license", "retrieved_at", "files"} - set(m)
    if missing:
        raise ValueError(f"manifest lacks {sorted(missing)}")
    return m


def sha256_of(path: str, block: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(block):
            h.update(part)
    return h.hexdigest()


def without_keys(value: object, keys: set[str]) -> object:
    """A value of parsed JSON without some keys, at any depth."""
    if isinstance(value, dict):
        return {k: without_keys(v, keys) for k, v in value.items() if k not in keys}
    return [without_keys(v, keys) for v in value] if isinstance(value, list) else value


def digest_id(prefix: str, content: object) -> str:
    """prefix, a dash and 16 hex digits that stand for the content, whatever the order of its keys."""
    return f"{prefix}-{hashlib.sha256(json.dumps(content, sort_keys=True, separators=(',', ':')).encode()).hexdigest()[:16]}"


def number(c: Column | str) -> Column:
    """A text as a number, null where it is none."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def text_sha256(text: str) -> str:
    """A digest that doesn't depend on line ends."""
    return hashlib.sha256(text.replace("\r\n", "\n").encode()).hexdigest()


def pair_files(spark: SparkSession, folder: str, manifest_path: str) -> tuple[DataFrame, DataFrame]:
    """(sound rows, malformed rows) of the CSV files a manifest lists; each file's digest is checked first."""
    files = manifest(manifest_path)["files"]
    for name, digest in files.items():
        if sha256_of(f"{folder}/{name}") != digest:
            raise ValueError(f"{name} isn't the file of the manifest")
    rows = None
    for name in sorted(files):  # headers may order their columns differently
        one = spark.read.csv(f"{folder}/{name}", header=True, multiLine=True, escape='"')
        missing = set(PAIR_COLUMNS) - set(one.columns)
        if missing:
            raise ValueError(f"{name} lacks {sorted(missing)}")
        one = one.select(*sorted(PAIR_COLUMNS), F.lit(name).alias("source_file"), F.lit((re.search(r"code_([A-Z])", name) or [None, None])[1]).alias("atc_category"))
        rows = one if rows is None else rows.unionByName(one)
    bad = F.lit(False)
    for c in PAIR_COLUMNS:
        bad = bad | is_blank(c)
    return rows.filter(~bad), rows.filter(bad)


def query_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by ddinter_id; of lines with one id the last counts."""
    lines = spark.read.schema(schema).json(path).withColumn("at", F.monotonically_increasing_id())
    return lines.withColumn("k", F.row_number().over(Window.partitionBy("ddinter_id").orderBy(F.desc("at")))).filter("k = 1").drop("k", "at")


def pending(drugs: DataFrame, cache: DataFrame) -> DataFrame:
    """Drugs that aren't cached, or whose last state was a passing failure."""
    again = cache.filter(F.col("http_status").isin(*TRANSIENT)).select("ddinter_id")
    return drugs.join(cache.select("ddinter_id"), "ddinter_id", "left_anti").unionByName(drugs.join(again, "ddinter_id", "left_semi"))


def merge_cache(cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """The cache with new results in place of old ones, in order of id."""
    return cache.join(fetched.select("ddinter_id"), "ddinter_id", "left_anti").unionByName(fetched, allowMissingColumns=True).orderBy("ddinter_id")


def write_json_report(report: dict, path: str) -> None:
    Path(path).write_text(json.dumps(report, indent=2, sort_keys=True) + "\n")


def append_lines(df: DataFrame, path: str) -> None:
    """JSON lines, added to those that are there."""
    df.write.mode("append").json(path)


def write_dataset(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """kind: parquet or csv (with a header)."""
    (df.write.mode("overwrite").option("header", True).csv if kind == "csv" else df.write.mode("overwrite").parquet)(path)


def markdown_table(text: str, header: str) -> list[list[str]]:
    """Cells of the table whose header line begins with `header`, up to the first line that is no row."""
    rows, inside = [], False
    for line in text.splitlines():
        if line.startswith(header):
            inside = True
        elif inside and not line.startswith("|"):
            break
        elif inside and set(line) - set("|-: "):
            rows.append([c.strip().strip("`") for c in line.strip().strip("|").split("|")])
    return rows


def markdown_section(text: str, heading: str, following: str) -> str:
    """What stands between two headings; empty if the first isn't there."""
    _, found, rest = text.partition(heading)
    return rest.partition(following)[0].strip() if found else ""

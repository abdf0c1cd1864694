"""Readers and writers: JSON documents, delimited text, tolerant logs, result sets, Markdown tables and sinks."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "<|endoftext|>"
RAW = "id string, source string, source_category string, title string, text string, content_tier string"


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents with file and ord, files that could not be parsed) of a tree of JSON files, one document each."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.col("value").alias("__json"), F.col("_metadata.file_path").alias("file"))
    parsed = parse_lines(files, "__json", RAW)
    return parsed.where("_ok").drop("_ok", "__json").withColumn("ord", F.xxhash64("file")), parsed.where(~F.col("_ok")).select("file")


def read_delimited(spark: SparkSession, path: str, separator: str = SEPARATOR) -> DataFrame:
    """Texts between separators, stripped, without empty ones."""
    return spark.read.option("lineSep", separator).text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("text")).where(F.length("text") > 0)


def read_texts(spark: SparkSession, paths: list[str], exclude: list[str] | None = None) -> DataFrame:
    """Whole .txt files of several folders, without the excluded names."""
    df = spark.read.option("pathGlobFilter", "*.txt").text(paths, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"))
    return df.where(~F.col("name").isin(exclude)) if exclude else df


def read_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(events, number of malformed lines) of JSON lines; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = parse_lines(lines, "value", schema)
    return parsed.where("_ok").drop("_ok", "value"), parsed.agg(F.sum((~F.col("_ok")).cast("long")).alias("n_malformed"))


def parse_lines(df: DataFrame, column: str, schema: str) -> DataFrame:
    """df with the fields of its JSON column and _ok; malformed lines keep null fields."""
    out = df.withColumn("__p", F.from_json(column, schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    return out.select("*", *[F.col(f"__p.{n}").alias(n) for n in names], (F.col("__p").isNotNull() & F.col("__p._corrupt").isNull()).alias("_ok")).drop("__p")


def complete_models(files: DataFrame, model: str, file: str, required: list[str]) -> DataFrame:
    """Models of which every required file is there."""
    return files.where(F.col(file).isin(required)).groupBy(model).agg(F.count_distinct(file).alias("n_files")).where(F.col("n_files") == len(required))


def read_markdown_table(text: str, heading: str) -> list[dict[str, str]]:
    """Rows of the first table under a heading."""
    rows: list[list[str]] = []
    inside = False
    for line in text.splitlines():
        if re.match(r"#+\s", line):
            if rows:
                break
            inside = line.lstrip("#").strip().lower() == heading.lower()
        elif inside and line.strip().startswith("|"):
            rows.append([c.strip() for c in line.strip().strip("|").split("|")])
        elif rows:
            break
    body = [r for r in rows[1:] if not all(re.fullmatch(r":?-+:?", c) for c in r)]
    return [dict(zip(rows[0], r, strict=False)) for r in body] if rows else []


def safe_id(column: Column) -> Column:
    return F.regexp_replace(column, r"[^a-zA-Z0-9_\-.]", "_")


def write_documents(df: DataFrame, path: str, directory: str, folders: dict[str, str] | None = None) -> None:
    """One folder per value of the column directory; folders: names of folders by value, others keep theirs."""
    if folders:
        mapped = F.coalesce(*[F.when(F.col(directory) == k, F.lit(v)) for k, v in folders.items()], F.col(directory))
        df = df.withColumn(directory, mapped)
    df.write.mode("overwrite").partitionBy(directory).parquet(path)


def write_concatenated(df: DataFrame, path: str, text: str = "text", separator: str = SEPARATOR) -> None:
    """Texts with the separator after each, one file per partition."""
    df.select(F.concat(F.col(text), F.lit("\n"), F.lit(separator)).alias("value")).write.mode("overwrite").text(path)


def write_rejects(rejects: list[DataFrame], path: str, mode: str = "append") -> None:
    """Rejected rows of all stages as JSON lines, added to what is there."""
    out = rejects[0]
    for r in rejects[1:]:
        out = out.unionByName(r)
    out.write.mode(mode).json(path)


def write_chunks(chunks: DataFrame, path: str, key: str) -> DataFrame:
    """Append chunks of documents that are not in the table yet; returns what was added."""
    spark = chunks.sparkSession
    try:
        known = spark.read.parquet(path).select(key).distinct()
        new = chunks.join(known, key, "left_anti")
    except Exception as e:  # the table is not there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new = chunks
    new.write.mode("append").parquet(path)
    return new


def write_tokens(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Token ids as parquet arrays, int because there are no unsigned shorts; beside them one row of what was written, returned too.

    order_free_hash: the sum of the rows' hashes, which tells two sinks of the same rows apart from others.
    """
    df.select(F.col(ids).cast("array<int>").alias("ids")).write.mode("overwrite").parquet(path)
    rows = df.sparkSession.read.parquet(path)
    told = rows.agg(F.count("*").alias("n_rows"), F.sum(F.size("ids").cast("long")).alias("n_tokens"), F.max(F.array_max("ids")).alias("largest_id"), F.sum(F.pmod(F.xxhash64("ids"), F.lit(1 << 32))).alias("order_free_hash"))
    told.write.mode("overwrite").json(f"{path}-meta")
    return df.sparkSession.read.schema(told.schema).json(f"{path}-meta")


def to_markdown(df: DataFrame, heading: str) -> DataFrame:
    """A small table, such as statistics, as one Markdown text under a heading; rows in the order of their text."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = f"# {heading}\n\n| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    return df.agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("text"))


def parse_markdown(texts: DataFrame, heading: str, text: str = "text") -> DataFrame:
    """Each row of the first table under the heading, as a map from column name to cell."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({"row": pd.Series([json.dumps(r) for t in batch[text] if t is not None for r in read_markdown_table(t, heading)], dtype="object")})

    return texts.select(text).mapInPandas(run, "row string").select(F.from_json("row", "map<string,string>").alias("row"))


def snapshot(df: DataFrame, path: str, version: str) -> None:
    """A version's table, written once: an existing one stays."""
    df.write.mode("ignore").parquet(f"{path}/version={version}")


def read_tables(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """Any of Spark's own formats."""
    if kind not in {"parquet", "orc", "csv", "json", "text", "binaryFile", "jdbc", "avro", "delta", "iceberg"}:
        raise ValueError(f"unknown format {kind}")
    return spark.read.format(kind).options(**options).load(path)

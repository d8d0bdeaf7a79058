"""Readers of landed files: score maps in JSON, JSON lines, CSV plans, archives, and text formats, as DataFrames."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def score_map(text: DataFrame, column: str = "value") -> DataFrame:
    """(benchmark, model, score) of JSON maps benchmark -> model -> score; keys with '_' in front and '_alias' entries are dropped.

    A map wrapped under 'scores' counts as that map. What is no number is no score.
    """
    outer = F.coalesce(F.from_json(F.get_json_object(column, "$.scores"), "map<string,string>"), F.from_json(column, "map<string,string>"))
    rows = text.select(F.explode(outer).alias("benchmark", "cells")).where(~F.col("benchmark").startswith("_"))
    cells = rows.select("benchmark", F.explode(F.from_json("cells", "map<string,string>")).alias("model", "score")).where(~F.col("model").startswith("_"))
    return cells.select("benchmark", "model", F.col("score").try_cast("double").alias("score")).where("score IS NOT NULL")


def scaled_fraction(c: Column) -> Column:
    """Scores above 1 and up to 100 are percent; only 0 to 1 is kept."""
    s = F.when((c > 1) & (c <= 100), c / 100).otherwise(c)
    return F.when(s.between(0, 1), s)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines with ``_corrupt`` set on malformed ones; blank lines and byte order marks are skipped."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).where(F.length(F.trim("value")) > 0)
    return lines.select(F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with quotes, doubled quotes and line feeds within fields; short rows are filled with ''."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True).fillna("")


def commented_json(text: Column, schema: str) -> Column:
    """JSON whose full-line // comments are dropped first."""
    return F.from_json(F.regexp_replace(text, r"(?m)^\s*//.*$", ""), schema)


def zip_members(files: DataFrame) -> DataFrame:
    """(path, member, size, text) of the members of ZIP archives read as binaryFile; a broken archive gives one row with a null member."""

    def run(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        out += [(path, i.filename, i.file_size, z.read(i).decode("utf-8", "replace")) for i in z.infolist() if not i.is_dir()]
                except zipfile.BadZipFile:
                    out.append((path, None, None, None))
            yield pd.DataFrame(out, columns=["path", "member", "size", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, size bigint, text string")


def table_rows(html: Column) -> Column:
    """(name, score) of the rows of an HTML table: first cell and last number; scores up to 1 are made percent."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)
    cell = lambda r, p: F.regexp_extract(r, p, 1)
    def one(r):
        s = F.regexp_replace(cell(r, r"(?is).*<td[^>]*>\s*([0-9.]+)\s*%?\s*</td>"), r"\.$", "").try_cast("double")
        return F.struct(F.trim(F.regexp_replace(cell(r, r"(?is)<td[^>]*>(.*?)</td>"), "<[^>]+>", "")).alias("name"), F.when(s <= 1, s * 100).otherwise(s).alias("score"))
    return F.filter(F.transform(rows, one), lambda x: x["score"].isNotNull() & (x["name"] != ""))


def all_ranges(total: Column, most: int = 100) -> Column:
    """ARRAY of (start, length) that covers ``total`` rows, ``most`` at a time; empty if there are none."""
    starts = F.when(total > 0, F.sequence(F.lit(0).cast("bigint"), F.greatest(total - 1, F.lit(0)).cast("bigint"), F.lit(most).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.least(F.lit(most), total - i).cast("int").alias("length")))


def sample_ranges(total: Column, n: int, most: int = 100, chunks: int = 10) -> Column:
    """ARRAY of (start, length): evenly strided chunks that sample n of ``total`` rows; all rows if there are no more than n.

    An unknown total (0 or less) gives the first rows.
    """
    k = max(1, min(chunks, -(-n // most)))
    size = max(1, min(most, n // k))
    stride, last = F.greatest(F.lit(1), F.floor(total / k)), F.greatest(F.lit(0), total - size)
    chunk = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(F.least(i * stride, last).cast("bigint").alias("start"), F.lit(size).alias("length")))
    first = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(min(n, most)).alias("length")))
    return F.when(total <= 0, first).when(total <= n, all_ranges(total, most)).otherwise(chunk)


def without_columns(df: DataFrame, skip: tuple[str, ...]) -> DataFrame:
    """A table without some columns, whatever their case; Parquet then doesn't read them."""
    low = {x.lower() for x in skip}
    return df.select(*[c for c in df.columns if c.lower() not in low])


def last_in_files(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by file and line (the columns of ``order``)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def yaml_blocks(text: Column) -> Column:
    """The blocks of a YAML list: each starts with '- ' at the beginning of a line."""
    return F.filter(F.split(text, r"\n(?=- )"), lambda b: b.startswith("- "))


def yaml_field(block: Column, key: str) -> Column:
    """A plain or quoted value of a key of a block, null if the block has none."""
    pattern = rf"(?m)^[- ] *{key}:[ ]*['\"]?(.*?)['\"]?[ ]*$"
    return F.when(block.rlike(pattern), F.regexp_extract(block, pattern, 1))


def payload_objects(html: Column, keys: tuple[str, ...]) -> Column:
    """ARRAY of STRUCT of the flat objects with the first of ``keys`` in a payload that scripts push in quoted pieces."""
    pieces = F.regexp_extract_all(html, F.lit(r'push\(\[1,"((?:[^"\\]|\\.)*)"\]\)'), 1)
    text = F.replace(F.array_join(pieces, ""), F.lit('\\"'), F.lit('"'))
    found = F.regexp_extract_all(text, F.lit(rf'\{{"{keys[0]}":[^{{}}]*\}}'), 0)
    return F.transform(found, lambda x: F.struct(*[F.get_json_object(x, f"$.{k}").alias(k) for k in keys]))


def plan_faults(plan: DataFrame, scopes: tuple[str, ...], header: tuple[str, ...] = ("scope", "benchmark", "model")) -> DataFrame:
    """Rows of a plan with ``fault``: 'scope' if it is unknown, 'doubled' if a cell stands there again, else 'none'. Raises for another header."""
    if tuple(plan.columns) != header:
        raise ValueError(f"the header is {plan.columns}, not {list(header)}")
    n = plan.groupBy(*header).agg(F.count(F.lit(1)).alias("_n"))
    return n.select(*header, F.explode(F.array_repeat(F.when(~F.col("scope").isin(*scopes), "scope").when(F.col("_n") > 1, "doubled").otherwise("none"), F.col("_n").cast("int"))).alias("fault"))


def score_files(spark: SparkSession, folders: list[str], schema: str) -> DataFrame:
    """Records of all score files of several folders: JSON arrays; drafts and names with a leading '_' are left out."""
    text = spark.read.text(folders, wholetext=True, pathGlobFilter="*.json").withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    kept = text.where(~F.startswith("_file", F.lit("_")) & ~F.endswith("_file", F.lit(".draft.json")))
    return kept.select("_file", F.explode(F.from_json("value", f"array<struct<{schema}>>")).alias("r")).select(F.col("_file").alias("file"), "r.*")


def latest(files: DataFrame, stem: Column) -> DataFrame:
    """The last file by name of each stem."""
    return files.groupBy(stem.alias("stem")).agg(F.max("path").alias("path"))

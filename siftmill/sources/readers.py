"""Readers for folders, text, CSV and JSON-line inputs, and sinks with a quarantine for failing rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accepted kinds of files; fixed values.
SUFFIXES = (".pdf", ".csv", ".npz", ".txt", ".docx", ".json")
_QA_SHAPES = "question string, answer string, q string, a string, messages array<struct<role:string,content:string>>"
_CONTENT_SHAPES = "question string, answer string, content string, text string, instruction string, input string, output string, title string, id string, source string, name string"


def folder_files(spark: SparkSession, folder: str, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(path, suffix, accepted, length) of every file below ``folder``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.withColumn("suffix", suffix).withColumn("accepted", F.col("suffix").isin(*suffixes))


def text_files(spark: SparkSession, path: str, language: Column | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """One row per file: title, text, char_count, language of the first 1,000 characters; ``extra`` names partition columns."""
    from ..functions.text import script_language

    reader = spark.read if extra else spark.read.option("recursiveFileLookup", "true")
    rows = reader.text(path, wholetext=True).select(*extra, F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1).alias("title"), F.col("value").alias("text"))
    return rows.withColumn("char_count", F.length("text")).withColumn("language", language if language is not None else script_language(F.col("text"), 1000))


def row_text(columns: Sequence[str]) -> Column:
    """``name: value | name: value``, null and blank cells left out."""
    cell = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string")))
    return F.concat_ws(" | ", *[cell(c) for c in columns])


def csv_records(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """CSV rows as text; lines that do not fit the schema are dropped."""
    rows = spark.read.csv(path, header=header, schema=schema, mode="DROPMALFORMED", escape='"')
    return rows.select("*", row_text(rows.columns).alias("line"))


def normalise_qa(lines: DataFrame, column: str) -> DataFrame:
    """Question and answer from the three accepted shapes; other lines have both null."""
    j = F.from_json(column, _QA_SHAPES)
    last = lambda role: F.try_element_at(F.filter(j["messages"], lambda m: m["role"] == role), F.lit(-1))["content"]
    question, answer = F.coalesce(j["question"], j["q"], last("user")), F.coalesce(j["answer"], j["a"], last("assistant"))
    return lines.withColumn("question", F.trim(question)).withColumn("answer", F.trim(answer))


def normalise_content(lines: DataFrame, column: str) -> DataFrame:
    """Content and title from the accepted record shapes, without NUL characters."""
    j = F.from_json(column, _CONTENT_SHAPES)
    qa = F.when(j["question"].isNotNull() & j["answer"].isNotNull(), F.concat(F.lit("Question: "), j["question"], F.lit("\n\nAnswer: "), j["answer"]))
    task = F.nullif(F.concat_ws("\n\n", j["instruction"], j["input"], j["output"]), F.lit(""))
    content = F.translate(F.coalesce(qa, j["content"], j["text"], task), "\0", "")
    title = F.coalesce(j["title"], j["id"], j["source"], j["name"], j["question"], F.substring(content, 1, 80))
    return lines.withColumn("content", content).withColumn("title", F.substring(title, 1, 200))


def top_level_objects(text: str) -> Iterator[str]:
    """Every balanced ``{...}`` outside strings."""
    depth, start, quoted, escaped = 0, 0, False, False
    for i, c in enumerate(text):
        if quoted:
            escaped, quoted = (not escaped and c == "\\"), not (c == '"' and not escaped)
        elif c == '"' and depth:
            quoted = True
        elif c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                yield text[start : i + 1]


def repaired_objects(texts: DataFrame, column: str) -> DataFrame:
    """One row per JSON object of concatenated objects; those that do not parse are skipped."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"object": [o for t in batch[column].dropna() for o in top_level_objects(t)]}, dtype=object)

    return texts.select(column).mapInPandas(split, "object string").where(F.expr("try_parse_json(object)").isNotNull())


def write_chunks(chunks: DataFrame, path: str, quarantine: str, required: Sequence[str] = ("title", "content")) -> None:
    """Appends good rows, partitioned for the metadata filters; rows without a required value go to ``quarantine``."""
    good = F.lit(True)
    for c in required:
        good = good & F.col(c).isNotNull() & (F.trim(c) != "")
    good = F.coalesce(good, F.lit(False))
    chunks.where(good).write.mode("append").partitionBy("source_type", "language").parquet(path)
    chunks.where(~good).write.mode("append").parquet(quarantine)


def write_chat_lines(records: DataFrame, path: str, column: str = "messages") -> None:
    """One JSON object per line, UTF-8 unescaped."""
    records.select(F.to_json(F.struct(column)).alias("value")).write.text(path)

"""Readers of text files: lines, user dictionaries, source lexicons, dumps, corpora and vectors."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsumugi.operators.delimited import tokenize as tokenize_records
from tsumugi.operators.lexicon import ENTRY
from tsumugi.operators.words import as_csv, as_dictionary_line, as_json, parse_lines
from tsumugi.runtime import numbered

INTEGER = re.compile(r"[+-]?[0-9]{1,9}\Z")

# Folders in which a system dictionary is looked for, in this order, after one below the home folder; files of a dictionary.
DICTIONARY_FOLDERS = (
    "/var/lib/mecab/dic/ipadic-utf8",
    "/usr/lib/mecab/dic/ipadic-utf8",
    "/usr/local/lib/mecab/dic/ipadic-utf8",
    "/usr/share/mecab/dic/ipadic-utf8",
    "/usr/lib/mecab/dic/ipadic",
    "/usr/local/lib/mecab/dic/ipadic",
    "/usr/share/mecab/dic/ipadic",
    "/usr/lib64/mecab/dic/ipadic",
)
HOME_FOLDER = ".local/share/tsumugi/dic/ipadic"  # below the home folder
SYSTEM, MATRIX, CHARACTERS, UNKNOWN_WORDS = "sys.dic", "matrix.bin", "char.bin", "unk.dic"
POOL, SURFACE_MAP = "semantic.bin", "surface_map.json"


def default_dictionary(folders: tuple[str, ...] = DICTIONARY_FOLDERS) -> str:
    """The first folder that holds a system dictionary, the one below the home folder first."""
    home = os.path.join(os.path.expanduser("~"), HOME_FOLDER)
    for folder in (home, *folders):
        if os.path.exists(os.path.join(folder, SYSTEM)):
            return folder
    raise FileNotFoundError("no system dictionary in " + ", ".join((home, *folders)))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file is there, on any file system that the session reads."""
    try:
        return spark.read.format("binaryFile").load(path).select("path").limit(1).count() > 0
    except AnalysisException:
        return False


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines with a text_id per line."""
    return spark.read.text(path).where(F.length("value") > 0).select(F.monotonically_increasing_id().alias("text_id"), F.col("value").alias("text"))


def user_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Valid entries of user dictionary files; parse_lines on the text gives the invalid ones."""
    return parse_lines(spark.read.text(path).withColumnRenamed("value", "line")).where(F.col("error").isNull()).drop("line", "error")


def _source_lines(spark: SparkSession, path: str) -> DataFrame:
    """Fields of source lexicon lines and the reason why a line is no entry; quoted fields may hold commas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(0).to_pylist()
            rows = []
            for line, fields, broken in zip(lines, *tokenize_records(lines)):
                numbers = [int(x) if INTEGER.match(x) else None for x in fields[1:4]]
                reason = "quoting" if broken >= 0 else "columns" if len(fields) < 5 else "number" if None in numbers or any(abs(x) > 32768 for x in numbers[2:]) else "surface" if not fields[0] else None
                rows.append((line, reason, *((fields[0], *numbers, ",".join(fields[4:])) if reason is None else (None,) * 5)))
            columns = list(zip(*rows)) if rows else [[]] * 7
            types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["line", "reason", "surface", "left_id", "right_id", "wcost", "feature"])

    lines = spark.read.text(path).where(F.length("value") > 0)
    return lines.mapInArrow(run, "line string, reason string, surface string, left_id int, right_id int, wcost int, feature string")


def source_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Lexicon entries of source files (surface, left id, right id, cost, feature...); no heading line.

    Word ids are consecutive in the order of the lines' text. Lines that are no entry are those
    of source_lexicon_errors.
    """
    entries = numbered(_source_lines(spark, path).where(F.col("reason").isNull()), [F.col("line")], "word_id")
    return entries.withColumn("pos_id", F.lit(0)).withColumn("layer", F.lit(1)).select(*[c.split()[0] for c in ENTRY.split(", ")])


def source_lexicon_errors(spark: SparkSession, path: str) -> DataFrame:
    """Lines of source files that are no entry, with the reason: quoting, columns, number or surface."""
    return _source_lines(spark, path).where(F.col("reason").isNotNull()).select("line", "reason")


def matrix_text(spark: SparkSession, path: str) -> DataFrame:
    """Connection costs of a text matrix: a heading with both sizes, then right id, left id and cost."""
    part = F.split(F.trim("value"), r"\s+")
    cells = spark.read.text(path).where(F.size(part) == 3)
    return cells.select(F.get(part, 0).cast("int").alias("right_id"), F.get(part, 1).cast("int").alias("left_id"), F.get(part, 2).cast("int").alias("cost"))


def entity_dump(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an entity dump (plain or gz) with a line_id, for nested.flatten_entities."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_id"), F.col("value").alias("line"))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """word_ids per line of white-space separated ids; other tokens are skipped, empty lines dropped."""
    ids = F.filter(F.transform(F.split(F.trim("value"), r"\s+"), lambda t: t.try_cast("bigint")), lambda w: w.between(0, 4294967295))
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("sent_id"), ids.alias("word_ids")).where(F.size("word_ids") > 0)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """word_id, feature and line_no (rising within the file) of a vocabulary file; # begins a comment line."""
    part = F.split("value", "\t", 2)
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    found = rows.select(F.get(part, 0).try_cast("bigint").alias("word_id"), F.get(part, 1).alias("feature"), F.monotonically_increasing_id().alias("line_no"))
    return found.where("word_id is not null and feature is not null")


def vectors_text(spark: SparkSession, path: str, words: DataFrame) -> DataFrame:
    """word_id and embedding from text vectors, by the base form of ``words`` (word_id, feature).

    Of several words with one base form the last one counts: by line_no if there is one, else by word_id.
    """
    raw = spark.read.text(path)
    part = F.split(F.trim("value"), r"\s+")
    head = raw.where(F.size(part) == 2).select(F.get(part, 1).try_cast("int")).first()
    dim = head[0] if head else 0
    base = F.get(F.split("feature", ","), 6)
    ids = words.where(base.isNotNull() & (base != "*")).groupBy(base.alias("surface")).agg(F.max_by("word_id", "line_no" if "line_no" in words.columns else "word_id").alias("word_id"))
    rows = raw.where(F.size(part) == dim + 1).select(F.get(part, 0).alias("surface"), F.transform(F.slice(part, 2, max(dim, 1)), lambda v: v.try_cast("float")).alias("embedding"))
    return rows.where(~F.exists("embedding", lambda v: v.isNull())).join(ids, "surface").select("word_id", "embedding")


def surface_map(spark: SparkSession, path: str) -> DataFrame:
    """(surface, uri, confidence, ord) from a JSON object of surface -> [[uri, confidence], ...]."""
    raw = spark.read.text(path, wholetext=True)
    pairs = raw.select(F.explode(F.from_json("value", "map<string,array<array<string>>>")).alias("surface", "candidates"))
    each = pairs.select("surface", F.posexplode("candidates").alias("ord", "c"))
    return each.select("surface", F.get("c", 0).alias("uri"), F.get("c", 1).try_cast("float").alias("confidence"), "ord")


def write_lines(df: DataFrame, path: str, column: str = "line") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_vectors_text(vectors: DataFrame, path: str) -> None:
    """Text vectors: a heading with count and dimension in a file of its own name order, then the rows."""
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).select(F.lit(0).alias("k"), F.concat_ws(" ", "n", "d").alias("line"))
    rows = vectors.select(F.lit(1).alias("k"), F.concat_ws(" ", F.col("word_id").cast("string"), F.array_join(F.transform("embedding", lambda v: F.format_string("%.6f", v)), " ")).alias("line"))
    size.unionByName(rows).orderBy("k", "line").select("line").write.mode("overwrite").text(path)


def write_vocabulary(entries: DataFrame, path: str) -> None:
    """word_id TAB feature per line, in the order of the ids."""
    rows = entries.where("word_id is not null").select("word_id", F.concat_ws("\t", F.col("word_id").cast("string"), "feature").alias("line"))
    write_lines(rows.orderBy("word_id"), path)


def write_user_dictionary(entries: DataFrame, path: str, form: str = "csv") -> None:
    """User entries as csv, dictionary lines or JSON lines."""
    line = {"csv": as_csv, "dictionary": as_dictionary_line, "json": as_json}[form]()
    write_lines(entries.select(line.alias("line")), path)


def first_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row per key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_r") == 1).drop("_r")

"""User dictionary operations: reading, validation, search, merging, statistics and formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsumugi.functions.features import escape_json
from tsumugi.functions.text import trim_whitespace
from tsumugi.operators.lexicon import ENTRY

DEFAULT_POS = "名詞,固有名詞,一般,*,*,*"
DEFAULT_COST = 0


def parse_lines(lines: DataFrame) -> DataFrame:
    """Entries of plain user lines (line): surface,reading,pronunciation,cost[,pos...]; others get an error.

    Fields have no quoting here. Blank lines and comments have no row; a line is valid with at
    least four fields and a 16-bit cost, and without a line break inside.
    """
    text = trim_whitespace("line")
    rows = lines.where((text != "") & ~text.startswith("#"))
    fields = F.transform(F.split(text, ","), trim_whitespace)
    cost = F.get(fields, 3).try_cast("smallint").cast("int")
    short = F.size(fields) < 4
    error = F.when(text.contains("\n"), "line break").when(short, "too few fields").when(cost.isNull(), "invalid cost")
    pos = F.when(F.size(fields) > 4, F.array_join(F.slice(F.split(text, ","), F.lit(5), F.size(fields)), ",")).otherwise(DEFAULT_POS)
    place = lambda i: F.get(fields, i)
    return rows.select("*", place(0).alias("surface"), place(1).alias("reading"), place(2).alias("pronunciation"), cost.alias("cost"), pos.alias("pos"), error.alias("error"))


def validation_counts(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count_if(F.col("error").isNull()).alias("n_valid"), F.count_if(F.col("error").isNotNull()).alias("n_invalid"))


def validation_errors(lines: DataFrame) -> DataFrame:
    """Line number, message and content of every line (line_no, line) that is no entry."""
    return parse_lines(lines).where(F.col("error").isNotNull()).select(*[c for c in lines.columns if c != "line"], F.col("error").alias("message"), trim_whitespace("line").alias("content"))


def sorted_by_surface(entries: DataFrame) -> DataFrame:
    return entries.orderBy("surface")


def sorted_by_cost(entries: DataFrame) -> DataFrame:
    """Cheapest first, by surface among equals."""
    return entries.orderBy("cost", "surface")


def find(entries: DataFrame, surface: str) -> DataFrame:
    return entries.where(F.col("surface") == surface)


def find_by_prefix(entries: DataFrame, prefix: str) -> DataFrame:
    return entries.where(F.col("surface").startswith(prefix))


def remove(entries: DataFrame, surface: str) -> DataFrame:
    return entries.where(~F.col("surface").eqNullSafe(F.lit(surface)))


def merge(entries: DataFrame, other: DataFrame, order: str) -> DataFrame:
    """``entries`` and, for each surface they lack, the first of ``other`` by ``order``."""
    missing = other.join(entries.select("surface").distinct(), "surface", "left_anti").select(*entries.columns)
    first = missing.withColumn("_r", F.row_number().over(Window.partitionBy("surface").orderBy(order))).where(F.col("_r") == 1).drop("_r")
    return entries.unionByName(first)


def statistics(entries: DataFrame) -> DataFrame:
    """Entries, distinct surfaces, cost range and mean, characters and mean length."""
    chars = F.sum(F.char_length("surface"))
    return entries.agg(
        F.count(F.lit(1)).alias("n_entries"), F.count_distinct("surface").alias("n_surfaces"), F.avg("cost").alias("avg_cost"), F.min("cost").alias("min_cost"), F.max("cost").alias("max_cost"),
        F.coalesce(chars, F.lit(0)).alias("total_chars"), F.coalesce(chars / F.count(F.lit(1)), F.lit(0.0)).alias("avg_surface_len"),
    )


def _member(name: str) -> Column:
    """A member of an entry as text: without a value the default pos or cost, else empty."""
    default = {"pos": DEFAULT_POS, "cost": str(DEFAULT_COST)}.get(name, "")
    return F.coalesce(F.col(name).cast("string"), F.lit(default))


def to_overlay(entries: DataFrame, left_id: int = 0, right_id: int = 0) -> DataFrame:
    """Lexicon entries of the run-time layer with feature pos,reading,pronunciation; no pos or cost counts as the default."""
    feature = F.concat_ws(",", _member("pos"), F.coalesce("reading", F.lit("*")), F.coalesce("pronunciation", F.lit("*")))
    made = entries.select("surface", F.lit(None).cast("long").alias("word_id"), F.lit(left_id).alias("left_id"), F.lit(right_id).alias("right_id"), F.lit(0).alias("pos_id"), F.coalesce("cost", F.lit(DEFAULT_COST)).alias("wcost"), feature.alias("feature"), F.lit(0).alias("layer"))
    return made.select(*[c.split()[0] for c in ENTRY.split(", ")])


def as_csv() -> Column:
    """surface,reading,pronunciation,cost,pos with every member in its place, as the two formats below."""
    return F.concat_ws(",", *map(_member, ("surface", "reading", "pronunciation", "cost", "pos")))


def as_dictionary_line() -> Column:
    """The line of a compiled dictionary's source: surface, context ids 0, cost, pos, reading."""
    return F.concat_ws(",", _member("surface"), F.lit("0"), F.lit("0"), _member("cost"), _member("pos"), _member("reading"))


def as_json() -> Column:
    text = lambda c: F.concat(F.lit(f'"{c}":"'), escape_json(_member(c), control=False), F.lit('"'))
    return F.concat(F.lit("{"), F.concat_ws(",", text("surface"), text("reading"), text("pronunciation"), F.concat(F.lit('"cost":'), _member("cost")), text("pos")), F.lit("}"))

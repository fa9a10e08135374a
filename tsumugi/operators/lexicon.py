"""The tables of a dictionary as one immutable bundle, and words added at run time.

A bundle holds DataFrames only: entries, connection costs and templates for unknown words.
Adding or removing words makes a new bundle; running queries keep theirs.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ENTRY = "surface string, word_id long, left_id int, right_id int, pos_id int, wcost int, feature string, layer int"
CONNECTION = "right_id int, left_id int, cost int"
UNKNOWN = "category string, entry_ix int, left_id int, right_id int, pos_id int, wcost int, feature string"
NO_CONNECTION = 32767  # fixed value: cost of a pair of ids without a cell
RUNTIME_CONTEXT = 1285  # fixed value: context id of words added at run time
UNKNOWN_COST = 10000  # fixed value: cost of an unknown word whose category has no template

# Ranges of code points by category, first match; and which categories group runs.
CATEGORIES = (
    (0x0020, 0x0020, "SPACE"), (0x0009, 0x000D, "SPACE"), (0x00A0, 0x00A0, "SPACE"), (0x3000, 0x3000, "SPACE"),
    (0x0030, 0x0039, "NUMERIC"), (0xFF10, 0xFF19, "NUMERIC"),
    (0x0041, 0x005A, "ALPHA"), (0x0061, 0x007A, "ALPHA"), (0x00C0, 0x024F, "ALPHA"), (0xFF21, 0xFF3A, "ALPHA"), (0xFF41, 0xFF5A, "ALPHA"),
    (0x0021, 0x007E, "SYMBOL"), (0x00A1, 0x00BF, "SYMBOL"), (0x2000, 0x206F, "SYMBOL"), (0x3001, 0x303F, "SYMBOL"), (0xFF01, 0xFF5E, "SYMBOL"),
    (0x3041, 0x309F, "HIRAGANA"), (0x30A1, 0x30FF, "KATAKANA"), (0xFF66, 0xFF9F, "KATAKANA"), (0x31F0, 0x31FF, "KATAKANA"),
    (0x4E00, 0x9FFF, "KANJI"), (0x3400, 0x4DBF, "KANJI"), (0xF900, 0xFAFF, "KANJI"),
    (0x0370, 0x03FF, "GREEK"), (0x0400, 0x052F, "CYRILLIC"),
)
KANJI_NUMERALS = "〇一二三四五六七八九十百千万億兆"
GROUPING = frozenset("DEFAULT SPACE SYMBOL NUMERIC ALPHA HIRAGANA KATAKANA KANJINUMERIC GREEK CYRILLIC".split())


# The character whose flag says whether its category groups runs, and the last code point of a table.
SAMPLES = {"DEFAULT": " ", "SPACE": " ", "KANJI": "漢", "SYMBOL": "!", "NUMERIC": "0", "ALPHA": "A", "HIRAGANA": "あ", "KATAKANA": "ア", "KANJINUMERIC": "一", "GREEK": "Α", "CYRILLIC": "А"}
LAST_CODE_POINT = 0xFFFE


@lru_cache(maxsize=65536)
def category(character: str) -> str:
    """Category of a character; beyond the basic plane and outside all ranges DEFAULT."""
    if character in KANJI_NUMERALS:
        return "KANJINUMERIC"
    point = ord(character)
    return next((name for lo, hi, name in CATEGORIES if lo <= point <= hi), "DEFAULT")


def category_sql(character: str) -> str:
    """The same as a SQL expression over a one-character string."""
    point = f"ascii({character})"
    cases = " ".join(f"WHEN {point} BETWEEN {lo} AND {hi} THEN '{name}'" for lo, hi, name in CATEGORIES)
    return f"CASE WHEN instr('{KANJI_NUMERALS}', {character}) > 0 THEN 'KANJINUMERIC' {cases} ELSE 'DEFAULT' END"


def _priced(rows: DataFrame, schema: str, cost: int) -> DataFrame:
    """The columns of a schema, with a cost for rows without one."""
    names = [c.split()[0] for c in schema.split(", ")]
    return rows.select(*[F.coalesce("wcost", F.lit(cost)).alias("wcost") if c == "wcost" else c for c in names])


@dataclass(frozen=True)
class Categories:
    """Categories of characters by a table of code points (None: the ranges above) and which of them group runs."""

    by_point: dict[int, str] | None = None
    grouping: frozenset[str] = GROUPING

    def __call__(self, character: str) -> str:
        return category(character) if self.by_point is None else self.by_point.get(ord(character), "DEFAULT")


@dataclass(frozen=True)
class Lexicon:
    """entries (ENTRY), connections (CONNECTION) and unknown-word templates (UNKNOWN).

    Entries without a cost cost 0, templates without one UNKNOWN_COST; ids that are NULL connect to
    nothing; entries without a surface are never found.

    ``characters`` (codepoint, category, group) is the character table of a dictionary; without
    one the ranges above hold. ``entities`` (surface, uri, confidence) come with a semantic pool.
    """

    entries: DataFrame
    connections: DataFrame
    unknown: DataFrame
    characters: DataFrame | None = None
    entities: DataFrame | None = None

    @classmethod
    def load(cls, spark: SparkSession, folder: str | None = None, semantics: str | None = None) -> Lexicon:
        """The compiled dictionary of a folder (the default one without), with the semantic pool
        ``semantics`` or the one in the folder, if there is one."""
        from tsumugi.sources import binary, files

        folder = folder or files.default_dictionary()
        path = lambda name: f"{folder.rstrip('/')}/{name}"
        for name in (files.SYSTEM, files.MATRIX, files.CHARACTERS, files.UNKNOWN_WORDS):
            if not files.exists(spark, path(name)):
                raise FileNotFoundError(path(name))
        templates = binary.read_dictionary(spark, path(files.UNKNOWN_WORDS), 2)
        unknown = templates.select(F.col("surface").alias("category"), F.col("word_id").cast("int").alias("entry_ix"), "left_id", "right_id", "pos_id", "wcost", "feature")
        first = unknown.groupBy("category").agg(F.min("entry_ix").alias("_first"))
        unknown = unknown.join(first, "category").withColumn("entry_ix", F.col("entry_ix") - F.col("_first")).drop("_first")
        characters = binary.read_characters(spark, path(files.CHARACTERS))
        lexicon = cls.of(binary.read_dictionary(spark, path(files.SYSTEM), 0), binary.read_matrix(spark, path(files.MATRIX)), unknown, characters)
        pool = semantics or (path(files.POOL) if files.exists(spark, path(files.POOL)) else None)
        return lexicon if pool is None else lexicon.with_semantics(pool)

    def with_semantics(self, pool: str) -> Lexicon:
        """With the entities of the surface map that lies beside a pool file: uris and their
        confidence, within 0 to 1. Without a map there are no entities."""
        from tsumugi.sources import files

        spark = self.entries.sparkSession
        names = f"{pool.rpartition('/')[0] or '.'}/{files.SURFACE_MAP}"
        if not files.exists(spark, names):
            return replace(self, entities=spark.createDataFrame([], "surface string, uri string, confidence float, ord int"))
        confidence = F.greatest(F.lit(0.0).cast("float"), F.least(F.lit(1.0).cast("float"), F.col("confidence")))
        return replace(self, entities=files.surface_map(spark, names).withColumn("confidence", confidence))

    @classmethod
    def of(cls, entries: DataFrame, connections: DataFrame | None = None, unknown: DataFrame | None = None, characters: DataFrame | None = None) -> Lexicon:
        spark = entries.sparkSession
        if "layer" not in entries.columns:
            entries = entries.withColumn("layer", F.lit(1))
        unknown = unknown if unknown is not None else spark.createDataFrame([], UNKNOWN)
        return cls(
            _priced(entries, ENTRY, 0),
            connections if connections is not None else spark.createDataFrame([], CONNECTION),
            _priced(unknown, UNKNOWN, UNKNOWN_COST),
            characters,
        )

    def categories(self) -> Categories:
        """The categories as the solvers hold them; the table has one row per code point of the basic plane at most."""
        if self.characters is None:
            return Categories()
        rows = self.characters.where(F.col("codepoint").between(0, LAST_CODE_POINT)).select("codepoint", "category", "group").collect()
        flags = {r.codepoint: r.group for r in rows}
        grouping = frozenset(name for name, c in SAMPLES.items() if flags.get(ord(c)))
        return Categories({r.codepoint: r.category for r in rows if r.category != "DEFAULT"}, grouping)

    def with_category(self, rows: DataFrame, character: str = "c") -> DataFrame:
        """Rows with the category of a column of single characters."""
        if self.characters is None:
            return rows.withColumn("category", F.expr(category_sql(character)))
        points = self.characters.where(F.col("codepoint").between(0, LAST_CODE_POINT)).select("codepoint", F.col("category").alias("_category"))
        joined = rows.withColumn("_point", F.ascii(character)).join(points, F.col("_point") == F.col("codepoint"), "left")
        return joined.withColumn("category", F.coalesce("_category", F.lit("DEFAULT"))).drop("_point", "codepoint", "_category")

    def with_entries(self, words: DataFrame) -> Lexicon:
        """Words of a layer above the system entries: they come first among equals."""
        added = words.withColumn("word_id", F.lit(None).cast("long")).withColumn("layer", F.lit(0))
        return replace(self, entries=self.entries.unionByName(_priced(added, ENTRY, 0)))

    def add_words(self, words: list[tuple[str, str, str, int]]) -> Lexicon:
        """Proper nouns given as (surface, reading, pronunciation, cost)."""
        rows = [(s, None, RUNTIME_CONTEXT, RUNTIME_CONTEXT, 0, c, f"名詞,固有名詞,一般,*,*,*,{s},{r},{p}", 0) for s, r, p, c in words]
        return self.with_entries(self.entries.sparkSession.createDataFrame(rows, ENTRY))

    def remove_words(self, surfaces: list[str]) -> Lexicon:
        """Without the run-time words of these surfaces, all homographs included."""
        return replace(self, entries=self.entries.where(~((F.col("layer") == 0) & F.col("surface").isin(surfaces))))

    def info(self) -> DataFrame:
        """Entries, surfaces, run-time words, ids of the connection costs, templates and categories with a template."""
        words = self.entries.agg(F.count(F.lit(1)).alias("n_entries"), F.count_distinct("surface").alias("n_surfaces"), F.count_if(F.col("layer") == 0).alias("n_runtime"))
        cells = self.connections.agg(F.count_distinct("right_id").alias("n_right_ids"), F.count_distinct("left_id").alias("n_left_ids"), F.count(F.lit(1)).alias("n_cells"))
        templates = self.unknown.agg(F.count(F.lit(1)).alias("n_templates"), F.count_distinct("category").alias("n_categories"))
        one = lambda df: df.withColumn("_one", F.lit(1))
        return one(words).join(one(cells), "_one").join(one(templates), "_one").drop("_one")

    def overlay_size(self) -> int:
        return self.entries.where(F.col("layer") == 0).count()

    def lookup(self, key: str) -> DataFrame:
        """Entries whose surface is a prefix of ``key``: run-time words first, then by length."""
        prefixes = [key[:n] for n in range(1, len(key) + 1)]
        found = self.entries.where(F.col("surface").isin(prefixes))
        return found.withColumn("length", F.char_length("surface")).orderBy("layer", "length", "word_id")


def example_lexicon(spark: SparkSession, words: list[tuple[str, int, int, int]], cells: list[tuple[int, int, int]]) -> Lexicon:
    """A small lexicon from (surface, left_id, right_id, cost) and (right_id, left_id, cost)."""
    entries = [(s, i, left, right, left, cost, f"名詞,一般,*,*,*,*,{s},{s},{s}", 1) for i, (s, left, right, cost) in enumerate(words)]
    return Lexicon.of(spark.createDataFrame(entries, ENTRY), spark.createDataFrame(cells, CONNECTION))

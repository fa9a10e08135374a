"""Entity linking: knowledge base, candidates, disambiguation and the semantic pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsumugi.functions.features import detect_source
from tsumugi.runtime import numbered

PRIOR = {"Wikidata": 1.2, "DBpedia": 1.1}  # fixed values
RESOLVED = 1.5  # fixed value


def popularity(n_sitelinks: Column) -> Column:
    """min(0.1 + min(sitelinks / 100, 0.9), 1) in single precision."""
    share = F.least((n_sitelinks.cast("float") / F.lit(100).cast("float")).cast("float"), F.lit(0.9).cast("float"))
    return F.least((F.lit(0.1).cast("float") + share).cast("float"), F.lit(1.0).cast("float"))


def knowledge_base(flat: DataFrame, language: str = "ja", prefix: str = "http://www.wikidata.org/entity/") -> DataFrame:
    """(surface, uri, confidence) from flat entity rows (entity_id, kind, map_key, ord_no, leaf_value).

    Surfaces are the label and the aliases of ``language``; a surface counts once per entity.
    """
    names = flat.where(F.col("kind").isin("label", "alias") & (F.col("map_key") == language) & F.col("leaf_value").isNotNull()).select("entity_id", F.col("leaf_value").alias("surface")).distinct()
    links = flat.where(F.col("kind") == "sitelink").groupBy("entity_id").agg(F.count_distinct("map_key").alias("n"))
    scored = names.join(links, "entity_id", "left")
    return scored.groupBy("surface", F.concat(F.lit(prefix), F.col("entity_id")).alias("uri")).agg(F.max(popularity(F.coalesce("n", F.lit(0)))).alias("confidence"))


def dedupe_candidates(candidates: DataFrame, order: list[str]) -> DataFrame:
    """First row per (surface, uri) by ``order``."""
    first = Window.partitionBy("surface", "uri").orderBy(*order)
    return candidates.withColumn("_r", F.row_number().over(first)).where(F.col("_r") == 1).drop("_r")


def distinct_entities(entities: Column) -> Column:
    """A token's entities (array of structs with uri) with the first of each uri only."""
    uris = F.transform(entities, lambda e: e["uri"])
    return F.filter(entities, lambda e, i: F.array_position(uris, e["uri"]) == i + 1)


def index_size(candidates: DataFrame) -> DataFrame:
    return candidates.agg(F.count_distinct("surface").alias("n_surfaces"), F.count(F.lit(1)).alias("n_mappings"))


def merge_candidates(entries: DataFrame, candidates: DataFrame, most: int, key: str = "entry_id") -> DataFrame:
    """Entries with n_candidates and their best ``most`` uris joined by ``|`` (0 and '' without any)."""
    order = Window.partitionBy("surface").orderBy(F.desc("confidence"), "uri")
    top = candidates.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    packed = top.groupBy("surface").agg(F.count(F.lit(1)).alias("n_candidates"), F.array_join(F.array_sort(F.collect_list(F.struct("_r", "uri"))).getField("uri"), "|").alias("uris"))
    return entries.join(packed, "surface", "left").select(key, "surface", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.coalesce("uris", F.lit("")).alias("uris"))


def link(tokens: DataFrame, candidates: DataFrame) -> DataFrame:
    """Tokens with their candidate entities; tokens without any keep one row with NULLs."""
    return tokens.join(candidates.select("surface", "uri", "confidence"), "surface", "left")


def scored(candidates: DataFrame, strategy: str, resolved: list[str] | None = None) -> DataFrame:
    """Candidates with the score of a strategy: highest, prior, context or none."""
    confidence = F.col("confidence").cast("float")
    if strategy == "prior":
        source = detect_source("uri") if "source" not in candidates.columns else F.col("source")
        boost = F.lit(1.0)
        for name, factor in PRIOR.items():
            boost = F.when(source == name, factor).otherwise(boost)
        confidence = (confidence * boost.cast("float")).cast("float")
    elif strategy == "context" and resolved:
        confidence = F.when(F.col("uri").isin(resolved), (confidence * F.lit(RESOLVED).cast("float")).cast("float")).otherwise(confidence)
    return candidates.withColumn("score", confidence)


def disambiguate(candidates: DataFrame, key: list[str], strategy: str = "highest", order: str = "ord", resolved: list[str] | None = None) -> DataFrame:
    """The winner per key (all, ranked, for strategy none); equal scores keep the order given."""
    ranked = scored(candidates, strategy, resolved).withColumn("rank_no", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), order)))
    return ranked if strategy == "none" else ranked.where(F.col("rank_no") == 1)


def clamp(confidence: Column) -> Column:
    """A given confidence in single precision, within [0, 1]."""
    return F.greatest(F.lit(0.0).cast("float"), F.least(F.lit(1.0).cast("float"), confidence.cast("float")))


def quantise(confidence: Column) -> Column:
    """floor(c * 255) of a confidence clamped to [0, 1]."""
    return F.floor((clamp(confidence) * F.lit(255).cast("float")).cast("float")).cast("int")


def semantic_pool(entries: DataFrame, order: list[str]) -> DataFrame:
    """Pool rows with ids from 1 in ``order``, quantised confidence and source."""
    return numbered(entries, order, "pool_id", 1).select("pool_id", "uri", (quantise(F.col("confidence")) / 255).alias("confidence"), detect_source("uri").alias("source"))


def pool_statistics(entries: DataFrame) -> DataFrame:
    """Entries, distinct uris, entries per source, and bytes of the distinct strings with their terminators."""
    by_uri = entries.where(F.col("uri").isNotNull()).groupBy("uri").agg(F.count(F.lit(1)).alias("n")).withColumn("s", detect_source("uri"))
    of = lambda s: F.coalesce(F.sum(F.when(F.col("s") == s, F.col("n"))), F.lit(0))
    return by_uri.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_entries"), F.count(F.lit(1)).alias("n_uris"), *[of(s).alias(f"n_{s.lower()}") for s in ("Wikidata", "DBpedia", "SchemaOrg", "Custom")],
        F.coalesce(F.sum(F.octet_length("uri") + 1), F.lit(0)).alias("string_bytes"),
    )

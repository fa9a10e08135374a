"""The build job: a source lexicon and an entity dump make a lexicon with entities."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsumugi.operators import entities as en
from tsumugi.operators.delimited import read_records, tokenize
from tsumugi.operators.nested import flatten_entities
from tsumugi.sources.binary import write_pool
from tsumugi.sources.files import POOL, SURFACE_MAP, entity_dump, write_lines

EXTENDED = "extended.csv"
MOST = 5


def extended_lexicon(lines: DataFrame, candidates: DataFrame, most: int = MOST) -> DataFrame:
    """Lexicon lines (row_id, surface, line) with two more fields: how many entities the surface
    has, at most ``most``, and their uris joined by ``|``; 0 and 0 without any."""
    merged = en.merge_candidates(lines.select("row_id", "surface"), candidates, most, "row_id").drop("surface")
    uris = F.when(F.col("n_candidates") == 0, "0").otherwise(F.concat(F.lit('"'), F.replace("uris", F.lit('"'), F.lit('""')), F.lit('"')))
    return lines.join(merged, "row_id").select("row_id", "surface", "n_candidates", F.concat_ws(",", "line", F.col("n_candidates").cast("string"), uris).alias("line"))


def surface_map_lines(candidates: DataFrame) -> DataFrame:
    """One JSON member per surface: its uris with their confidence, the most confident first."""
    listed = candidates.groupBy("surface").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("o"), "uri", "confidence"))).alias("e"))
    pairs = F.transform("e", lambda e: F.concat(F.lit("["), F.to_json(F.struct(e["uri"].alias("u"))).substr(F.lit(6), F.length(F.to_json(F.struct(e["uri"].alias("u")))) - 6), F.lit(","), e["confidence"].cast("double").cast("string"), F.lit("]")))
    return listed.select("surface", F.concat(F.lit("["), F.array_join(pairs, ","), F.lit("]")).alias("uris"))


def write_surface_map(candidates: DataFrame, path: str) -> None:
    """The surface map as one JSON object; its members stream through the driver one by one."""
    with open(path, "w") as out:
        out.write("{")
        for i, r in enumerate(surface_map_lines(candidates).orderBy("surface").toLocalIterator()):
            out.write(("," if i else "") + json.dumps(r.surface, ensure_ascii=False) + ":" + r.uris)
        out.write("}")


def build(spark: SparkSession, source_csv: str, dump: str, output_dir: str, most: int = MOST, language: str = "ja") -> dict[str, int]:
    """Write the pool, the surface map and the extended lexicon of a source lexicon and an entity
    dump into a folder; numbers of entries, of those with entities, and of entities given.

    Lines that are not well-formed have no surface and get no entities; the files of the pool
    and the map are local ones, as their formats ask.
    """
    lines = entity_dump(spark, dump)
    ids = lines.select("line_id", F.regexp_extract("line", r'"id"\s*:\s*"(Q\d+)"', 1).alias("entity_id")).where(F.col("entity_id") != "")
    candidates = en.knowledge_base(flatten_entities(lines).join(ids, "line_id"), language)
    pool = candidates.groupBy("uri").agg(F.max("confidence").alias("confidence"))
    write_pool(en.numbered(pool, [F.col("uri")], "pool_id", 1), f"{output_dir}/{POOL}")
    write_surface_map(candidates, f"{output_dir}/{SURFACE_MAP}")

    def surfaces(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            fields, broken = tokenize(texts)
            yield pa.RecordBatch.from_arrays([ids, pa.array([None if b >= 0 else f[0] for f, b in zip(fields, broken)], pa.string()), batch.column(1)], names=["row_id", "surface", "line"])

    source = read_records(spark, source_csv, "source").where(F.length("line") > 0).select("row_id", "line").mapInArrow(surfaces, "row_id long, surface string, line string")
    extended = extended_lexicon(source, candidates, most)
    write_lines(extended.orderBy("row_id"), f"{output_dir}/{EXTENDED}")
    n = extended.agg(F.count(F.lit(1)), F.count_if(F.col("n_candidates") > 0), F.coalesce(F.sum("n_candidates"), F.lit(0))).first()
    return {"n_entries": n[0], "n_with_entities": n[1], "n_candidates": n[2]}

"""Deeply nested records into flat child tables that keep their parent keys.

The JVM parses each line once into a VARIANT and shapes its maps into lists of entries;
the flattening itself works on Arrow buffers: list offsets give parent indices, child
arrays are concatenated buffers, and keys reach the children by ``take``. No record is
visited one by one in Python.

Maps whose entries all have the usual shape are cast as a whole; only lines with another
shape are looked at entry by entry.

Defined results: a line without one complete JSON object (NULL, blank, cut off or an array)
has no rows; of members repeated in one object the last counts; members that are missing or null have no row;
a single item in place of an array is an array of one; a bare string in place of an object
is its value. Repeated identical rows count once; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f")
FLAT = "line_id long, kind string, map_key string, ord_no int, leaf_value string"


def entity_json(line: Column) -> Column:
    """The line without the dump's array brackets, commas and blanks around its entity."""
    return F.rtrim(F.ltrim(line, F.lit(WHITE + "[,\ufeff")), F.lit(WHITE + "],"))


def _leaf(x: str, member: str) -> str:
    """SQL for the text of item ``x``: the object's member, or the item itself if it is a bare value."""
    kind = f"schema_of_variant({x})"
    return (
        f"case when {kind} like 'OBJECT%' then try_variant_get({x}, '$.{member}', 'string') "
        f"when {kind} = 'VOID' or {kind} like 'ARRAY%' then null else try_variant_get({x}, '$', 'string') end"
    )


def _items(x: str, member: str) -> str:
    """SQL for array ``x`` as array<string>; one item in place of an array is an array of one."""
    kind = f"schema_of_variant({x})"
    return (
        f"case when {x} is null or {kind} = 'VOID' then cast(array() as array<string>) "
        f"when {kind} like 'ARRAY%' then transform(try_variant_get({x}, '$', 'array<variant>'), i -> {_leaf('i', member)}) "
        f"else array({_leaf(x, member)}) end"
    )


def _badges(x: str) -> str:
    """SQL for badges ``x``, mostly an array of bare values; objects and lists in it would be cast to text."""
    bare = f"try_variant_get({x}, '$', 'array<string>')"
    return f"case when {x} is null then cast(array() as array<string>) when {bare} is not null and not exists({bare}, b -> b like '{{%' or b like '[%') then {bare} else {_items(x, 'value')} end"


def _entries(name: str, usual: str, usual_fields: str, fields: str, fits: str) -> Column:
    """The entries of map member ``name`` of v: key k and fields made of e.value.

    ``usual`` is the type of a map's values in the usual shape and ``usual_fields`` what is
    made of them if the map has that type and ``fits``; ``fields`` work on any variant.
    """
    cast = f"try_variant_get(v, '$.{name}', 'map<string,{usual}>')"
    any_shape = f"map_entries(try_variant_get(v, '$.{name}', 'map<string,variant>'))"
    return F.expr(
        f"case when {cast} is not null and {fits.format(cast)} then transform(map_entries({cast}), e -> named_struct('k', e.key, {usual_fields})) "
        f"else transform({any_shape}, e -> named_struct('k', e.key, {fields})) end"
    ).alias(name)


def shape_entities(lines: DataFrame) -> DataFrame:
    """line_id with the entries of labels, aliases and sitelinks as arrays of structs.

    Sets ``spark.sql.variant.allowDuplicateKeys`` in the session, so that an object with a
    repeated key does not cost its line.
    """
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    rows = lines.select(F.col("line_id").cast("long").alias("line_id"), entity_json(F.col("line")).alias("entity"))
    rows = rows.where(F.col("entity").startswith("{")).dropDuplicates()
    parsed = rows.select("line_id", F.expr("try_parse_json(entity)").alias("v"))
    member = "try_variant_get(e.value, '$.badges', 'variant')"
    there = "not exists(map_values({0}), x -> x is null)"  # a value of another shape is NULL in the cast, as null itself
    items = "not exists(map_values({0}), x -> x is null or exists(x, i -> i is null))"
    return parsed.where("v is not null and schema_of_variant(v) like 'OBJECT%'").select(
        "line_id",
        _entries("labels", "struct<value:string>", "'v', e.value.value", f"'v', {_leaf('e.value', 'value')}", there),
        _entries("aliases", "array<struct<value:string>>", "'v', transform(e.value, i -> i.value)", f"'v', {_items('e.value', 'value')}", items),
        _entries(
            "sitelinks", "struct<title:string,badges:variant>", f"'t', e.value.title, 'b', {_badges('e.value.badges')}",
            f"'t', {_leaf('e.value', 'title')}, 'b', case when schema_of_variant(e.value) like 'OBJECT%' then {_items(member, 'value')} end", there,
        ),
    )


def _level(parent: np.ndarray, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """One level of list offsets: the parent index of each child, its place, and the children."""
    child = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    place = np.arange(len(child)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return parent[child], place, pc.list_flatten(lists)


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["line_id", "kind", "map_key", "ord_no", "leaf_value"]

    def table(ids: pa.Array, kind: str, root: np.ndarray, keys: pa.Array, place: np.ndarray, values: pa.Array) -> pa.RecordBatch:
        there = pc.is_valid(values)
        columns = [ids.take(pa.array(root)), pa.array([kind], pa.string()).take(pa.array(np.zeros(len(root), np.int64))), keys, pa.array(place, pa.int32()), values]
        return pa.RecordBatch.from_arrays([c.filter(there) for c in columns], names=names)

    for batch in batches:
        ids, labels, aliases, sitelinks = batch.columns
        rows = np.arange(len(ids))
        root, _, entries = _level(rows, labels)
        yield table(ids, "label", root, entries.field("k"), np.zeros(len(root)), entries.field("v"))
        root, _, entries = _level(rows, aliases)
        at, place, values = _level(np.arange(len(root)), entries.field("v"))
        yield table(ids, "alias", root[at], entries.field("k").take(pa.array(at)), place, values)
        root, _, entries = _level(rows, sitelinks)
        yield table(ids, "sitelink", root, entries.field("k"), np.zeros(len(root)), entries.field("t"))
        at, place, values = _level(np.arange(len(root)), entries.field("b"))
        yield table(ids, "badge", root[at], entries.field("k").take(pa.array(at)), place, values)


def flatten_entities(lines: DataFrame) -> DataFrame:
    """Rows (line_id, kind, map_key, ord_no, leaf_value) for label, alias, sitelink and badge."""
    return shape_entities(lines).mapInArrow(_flatten, FLAT)

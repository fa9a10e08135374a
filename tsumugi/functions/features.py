"""Feature strings, URIs and escaping as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsumugi.functions.text import _text

# The places of a feature string, URI prefixes, and classes of entities.
FIELDS = ("pos1", "pos2", "pos3", "pos4", "conjugation_type", "conjugation_form", "base", "reading", "pronunciation")
NAMESPACE = "http://example.org/ns#"
PREFIXES = {
    "wd": "http://www.wikidata.org/entity/",
    "wdt": "http://www.wikidata.org/prop/direct/",
    "dbr": "http://dbpedia.org/resource/",
    "dbo": "http://dbpedia.org/ontology/",
    "schema": "http://schema.org/",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "tok": NAMESPACE,
}
COMPACT = ("wd", "dbr", "schema")
SCHEMA_ORG = {"person": "Person", "place": "Place", "organization": "Organization", "event": "Event", "work": "CreativeWork", "product": "Product", "other": "Thing"}
POS_CLASSES = {"名詞": "noun", "動詞": "verb", "形容詞": "adjective", "形状詞": "adjective", "助詞": "particle", "助動詞": "auxiliary", "記号": "symbol", "補助記号": "symbol"}


def parse_feature(feature: Column | str) -> Column:
    """Struct of the nine comma-separated places; missing ones are NULL."""
    parts = F.split(_text(feature), ",")
    return F.struct(*[F.get(parts, i).alias(name) for i, name in enumerate(FIELDS)])


def full_pos(feature: Column | str) -> Column:
    """The first four places without ``*``, joined by ``-``."""
    return F.array_join(F.filter(F.slice(F.split(_text(feature), ","), 1, 4), lambda p: p != "*"), "-")


def token_dict(surface: Column, feature: Column) -> Column:
    """Struct of a token's members: pos to pos3 if the feature has them, the rest only if not ``*``."""
    f = parse_feature(feature)
    plain = {"pos": "pos1", "pos1": "pos2", "pos2": "pos3", "pos3": "pos4"}
    optional = {"inflection": "conjugation_type", "conjugation": "conjugation_form", "base": "base", "reading": "reading", "pronunciation": "pronunciation"}
    return F.struct(
        surface.alias("surface"), feature.alias("feature"),
        *[f.getField(field).alias(name) for name, field in plain.items()],
        *[F.nullif(f.getField(field), F.lit("*")).alias(name) for name, field in optional.items()],
    )


def pos_class(feature: Column | str) -> Column:
    out = F.lit("other")
    for head, name in reversed(POS_CLASSES.items()):
        out = F.when(F.startswith(_text(feature), F.lit(head)), name).otherwise(out)
    return out


def _escape(x: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def escape_turtle(x: Column | str) -> Column:
    return _escape(_text(x), [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")])


def escape_dot(x: Column | str) -> Column:
    return escape_turtle(x)


def escape_json(x: Column | str, control: bool = True) -> Column:
    """JSON string escapes; further control characters as u-escapes if ``control``."""
    x = escape_turtle(x)
    return _escape(x, [(chr(c), f"\\u{c:04x}") for c in range(32) if chr(c) not in "\n\r\t"]) if control else x


def compact_uri(uri: Column | str) -> Column:
    uri = _text(uri)
    out = uri
    for p in reversed(COMPACT):
        out = F.when(uri.startswith(PREFIXES[p]), F.concat(F.lit(f"{p}:"), F.substring(uri, F.lit(len(PREFIXES[p]) + 1), F.length(uri)))).otherwise(out)
    return out


def _expand(curie: Column, prefixes: tuple[str, ...], otherwise: Column) -> Column:
    for p in reversed(prefixes):
        otherwise = F.when(curie.startswith(f"{p}:"), F.concat(F.lit(PREFIXES[p]), F.substring(curie, F.lit(len(p) + 2), F.length(curie)))).otherwise(otherwise)
    return otherwise


def expand_uri(curie: Column | str) -> Column:
    """Full URI of a compact one; http URIs as they are; NULL for any other."""
    curie = _text(curie)
    return _expand(curie, COMPACT, F.when(curie.startswith("http://") | curie.startswith("https://"), curie))


def expand_any(curie: Column | str) -> Column:
    """Full URI for all known prefixes, anything else unchanged."""
    curie = _text(curie)
    return _expand(curie, tuple(PREFIXES), curie)


def detect_source(uri: Column | str) -> Column:
    uri = _text(uri)
    return F.when(uri.contains("wikidata.org"), "Wikidata").when(uri.contains("dbpedia.org"), "DBpedia").when(uri.contains("schema.org"), "SchemaOrg").otherwise("Custom")


def schema_org_type(kind: Column | str) -> Column:
    types = F.create_map(*[F.lit(v) for item in SCHEMA_ORG.items() for v in item])
    return F.concat(F.lit(PREFIXES["schema"]), F.coalesce(F.element_at(types, F.lower(_text(kind))), F.lit("Thing")))


def is_wikidata_dump(path: Column | str) -> Column:
    name = F.substring_index(_text(path), "/", -1)
    return name.contains("wikidata") & (name.endswith(".json") | name.endswith(".json.gz"))


def is_wikipedia_dump(path: Column | str) -> Column:
    name = F.substring_index(_text(path), "/", -1)
    return name.contains("wikipedia") | name.contains("abstract")

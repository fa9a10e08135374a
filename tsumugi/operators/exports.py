"""Analysis results as text: plain formats, JSON, JSON-LD, RDF triples and graphs.

Everything works on a token table (text_id, token_ix, surface, feature, ...). The lines of a
text are put together per text; triples stay a table, one row each, until they are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsumugi.functions.features import NAMESPACE, PREFIXES, compact_uri, escape_dot, escape_json, escape_turtle

BASE = "http://example.org/analysis"
GRAPH = "http://example.org/graph"
SHOWN = 8  # fixed value: dimensions of a vector that the plain format shows


def _document(tokens: DataFrame, line: Column, separator: str, name: str, head: str = "", tail: str = "") -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("token_ix", line.alias("line"))))
    text = F.array_join(F.transform(lines, lambda x: x["line"]), separator)
    return tokens.groupBy("text_id").agg(F.concat(F.lit(head), text, F.lit(tail)).alias(name))


def _decimals(vector: Column, n: int) -> Column:
    return F.transform(F.slice(vector, 1, n) if n else vector, lambda v: F.format_string("%.3f", v))


def plain(tokens: DataFrame) -> DataFrame:
    """surface TAB feature per line, with lines for IPA and vector where the token has them, then EOS."""
    line = F.concat(F.col("surface"), F.lit("\t"), F.col("feature"))
    if "ipa" in tokens.columns:
        line = F.concat(line, F.coalesce(F.concat(F.lit("\n  IPA: /"), F.col("ipa"), F.lit("/")), F.lit("")))
    if "embedding" in tokens.columns:
        more = F.when(F.size("embedding") > SHOWN, ", ...").otherwise("")
        vector = F.concat(F.lit("\n  Vector: ["), F.array_join(_decimals(F.col("embedding"), SHOWN), ", "), more, F.lit("] (dim="), F.size("embedding").cast("string"), F.lit(")"))
        line = F.concat(line, F.when(F.col("embedding").isNotNull(), vector).otherwise(""))
    return _document(tokens, line, "\n", "plain", tail="\nEOS\n")


def dump(tokens: DataFrame) -> DataFrame:
    """Numbered tokens with their costs; a token without pos_id or wcost has 0, as in ``jsonld``."""
    number = F.concat(F.lit("["), F.col("token_ix").cast("string"), F.lit("] "))
    costs = F.concat(F.lit(" (pos_id="), F.coalesce("pos_id", F.lit(0)).cast("string"), F.lit(", wcost="), F.coalesce("wcost", F.lit(0)).cast("string"), F.lit(")\t"))
    return _document(tokens, F.concat(number, F.col("surface"), costs, F.col("feature")), "\n", "dump", tail="\nEOS\n")


def json(tokens: DataFrame) -> DataFrame:
    line = F.concat(F.lit('{"surface":"'), escape_json("surface"), F.lit('","feature":"'), escape_json("feature"), F.lit('"}'))
    return _document(tokens, line, ",", "json", "[", "]")


def wakati(tokens: DataFrame) -> DataFrame:
    return _document(tokens, F.col("surface"), " ", "wakati")


def word_ids(tokens: DataFrame) -> DataFrame:
    """Word ids by blanks; unknown words as the largest unsigned 32-bit number."""
    return _document(tokens, F.coalesce(F.col("word_id"), F.lit(4294967295)).cast("string"), " ", "word_ids")


def n_best(tokens: DataFrame) -> DataFrame:
    """Per path a heading with number and cost, then its lines and EOS."""
    lines = F.array_sort(F.collect_list(F.struct("token_ix", F.concat(F.col("surface"), F.lit("\t"), F.col("feature")).alias("line"))))
    paths = tokens.groupBy("text_id", "path_no", "path_cost").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("body"))
    block = F.concat(F.lit("# "), F.col("path_no").cast("string"), F.lit(" (cost="), F.col("path_cost").cast("string"), F.lit(")\n"), F.col("body"), F.lit("\nEOS\n"))
    blocks = F.array_sort(F.collect_list(F.struct("path_no", block.alias("b"))))
    return paths.groupBy("text_id").agg(F.array_join(F.transform(blocks, lambda x: x["b"]), "").alias("n_best"))


def jsonld(tokens: DataFrame) -> DataFrame:
    """JSON-LD document; ``entities`` is an array of (uri, confidence), left out where empty."""
    text = lambda name, value: F.concat(F.lit(f'      "{name}": "'), value, F.lit('",\n'))
    fields = F.split("feature", ",")
    reading = F.get(fields, 7)
    line = F.concat(F.lit("    {\n"), text("surface", escape_json("surface")), text("pos", escape_json(F.coalesce(F.get(fields, 0), F.lit("*")))), F.when(reading.isNotNull() & (reading != "*"), text("reading", escape_json(reading))).otherwise(""))
    if "ipa" in tokens.columns:
        line = F.concat(line, F.when(F.col("ipa").isNotNull(), text("pronunciation", F.concat(F.lit("/"), F.col("ipa"), F.lit("/")))).otherwise(""))
    if "embedding" in tokens.columns:
        vector = F.concat(F.lit('      "embedding": ['), F.array_join(_decimals(F.col("embedding"), 0), ", "), F.lit("],\n"))
        line = F.concat(line, F.when(F.col("embedding").isNotNull(), vector).otherwise(""))
    line = F.concat(line, F.lit('      "wcost": '), F.coalesce(F.col("wcost"), F.lit(0)).cast("string"))
    if "entities" in tokens.columns:
        each = F.transform("entities", lambda e: F.concat(F.lit('        {"@id": "'), escape_json(compact_uri(e["uri"])), F.lit('", "confidence": '), F.format_string("%.2f", e["confidence"]), F.lit("}")))
        line = F.concat(line, F.when(F.size("entities") > 0, F.concat(F.lit(',\n      "entities": [\n'), F.array_join(each, ",\n"), F.lit("\n      ]"))).otherwise(""))
    context = ",\n".join(f'    "{p}": "{PREFIXES[p]}"' for p in ("wd", "dbr", "schema", "tok"))
    head = '{\n  "@context": {\n' + context + '\n  },\n  "@type": "tok:Analysis",\n  "tokens": [\n'
    return _document(tokens, F.concat(line, F.lit("\n    }")), ",\n", "jsonld", head, "\n  ]\n}")


def token_jsonld(entities: DataFrame) -> Column:
    """A token alone as compact JSON: surface, pos, reading and entities where present."""
    return F.to_json(F.struct("surface", "pos", "reading", "entities"), {"ignoreNullFields": "true"})


def triples(tokens: DataFrame, base: str = BASE) -> DataFrame:
    """(text_id, token_ix, subject, predicate, object) rows: type, surface, pos, reading and entities."""
    fields = F.split("feature", ",")
    reading = F.nullif(F.get(fields, 7), F.lit("*"))
    subject = F.concat(F.lit(f"<{base}#token"), F.col("token_ix").cast("string"), F.lit(">"))
    literal = lambda c: F.concat(F.lit('"'), escape_turtle(c), F.lit('"'))
    row = lambda p, o: F.struct(F.lit(p).alias("predicate"), o.alias("object"))
    rows = [
        row(f"<{PREFIXES['rdf']}type>", F.lit(f"<{NAMESPACE}Token>")),
        row(f"<{NAMESPACE}surface>", literal(F.col("surface"))),
        row(f"<{NAMESPACE}pos>", literal(F.get(fields, 0))),
        row(f"<{NAMESPACE}reading>", literal(reading)),
    ]
    all_rows = F.array(*rows)
    if "entities" in tokens.columns:
        links = F.transform(F.coalesce("entities", F.array()), lambda e: row(f"<{NAMESPACE}entity>", F.concat(F.lit("<"), e["uri"], F.lit(">"))))
        all_rows = F.concat(all_rows, links)
    exploded = tokens.select("text_id", "token_ix", subject.alias("subject"), F.explode(all_rows).alias("t"))
    return exploded.select("text_id", "token_ix", "subject", "t.predicate", "t.object").where(F.col("object").isNotNull())


def ntriples(rows: DataFrame) -> DataFrame:
    return rows.select("text_id", "token_ix", F.concat_ws(" ", "subject", "predicate", "object", F.lit(".")).alias("line"))


def nquads(rows: DataFrame, graph: str = GRAPH) -> DataFrame:
    return rows.select("text_id", "token_ix", F.concat_ws(" ", "subject", "predicate", "object", F.lit(f"<{graph}>"), F.lit(".")).alias("line"))


def turtle(tokens: DataFrame, base: str = BASE) -> DataFrame:
    fields = F.split("feature", ",")
    reading = F.nullif(F.get(fields, 7), F.lit("*"))
    literal = lambda name, c: F.concat(F.lit(f'    tok:{name} "'), escape_turtle(c), F.lit('"'))
    parts = [literal("surface", F.col("surface")), literal("pos", F.get(fields, 0)), literal("reading", reading)]
    if "entities" in tokens.columns:
        uris = F.transform("entities", lambda e: F.concat(F.lit("<"), e["uri"], F.lit(">")))
        parts.append(F.when(F.size("entities") > 0, F.concat(F.lit("    tok:entity "), F.array_join(uris, ", "))))
    line = F.concat(F.lit("<#token"), F.col("token_ix").cast("string"), F.lit("> a tok:Token ;\n"), F.concat_ws(" ;\n", *parts), F.lit(" .\n\n"))
    head = f"@base <{base}> .\n" + "".join(f"@prefix {p}: <{u}> .\n" for p, u in PREFIXES.items()) + "\n"
    return _document(tokens, line, "", "turtle", head)


def dot(nodes: DataFrame, edges: DataFrame, rankdir: str = "LR", shape: str = "box", detailed: bool = False) -> DataFrame:
    """Graph description of each lattice; unknown words yellow, begin and end as diamonds."""
    name = lambda end, ix: F.concat(F.lit("n"), end.cast("string"), F.lit("_"), ix.cast("string"))
    label = F.concat_ws("\\n", escape_dot("surface"), F.concat(F.lit("cost="), F.col("wcost").cast("string")), *([escape_dot("feature")] if detailed else []))
    style = F.when(F.col("is_unknown"), ', style=filled, fillcolor=yellow').otherwise("")
    node = nodes.select("text_id", F.lit(0).alias("k"), F.concat(F.lit("  "), name(F.col("end_pos"), F.col("node_ix")), F.lit(' [label="'), label, F.lit(f'", shape={shape}'), style, F.lit("];")).alias("line"))
    ends = edges.select("text_id", F.explode(F.array(F.struct(F.col("from_end").alias("e"), F.col("from_ix").alias("i")), F.struct(F.col("to_end").alias("e"), F.col("to_ix").alias("i")))).alias("x")).where(F.col("x.i") == -1).distinct()
    border = ends.select("text_id", F.lit(0).alias("k"), F.concat(F.lit("  n"), F.col("x.e").cast("string"), F.lit('_b [label="'), F.when(F.col("x.e") == 0, "BOS").otherwise("EOS"), F.lit('", shape=diamond];')).alias("line"))
    ix = lambda c: F.when(c == -1, "b").otherwise(c.cast("string"))
    edge = edges.select("text_id", F.lit(1).alias("k"), F.concat(F.lit("  "), name(F.col("from_end"), ix(F.col("from_ix"))), F.lit(" -> "), name(F.col("to_end"), ix(F.col("to_ix"))), F.lit(' [label="'), F.col("ccost").cast("string"), F.lit('"];')).alias("line"))
    lines = F.array_sort(F.collect_list(F.struct("k", "line")))
    body = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    return node.unionByName(border).unionByName(edge).groupBy("text_id").agg(F.concat(F.lit(f"digraph lattice {{\n  rankdir={rankdir};\n"), body, F.lit("\n}\n")).alias("dot"))


class Sparql:
    """Text of a SPARQL query, put together step by step."""

    def __init__(self, variables: tuple[str, ...] = (), patterns: tuple[str, ...] = (), filters: tuple[str, ...] = (), most: int | None = None, skip: int | None = None):
        self.variables, self.patterns, self.filters, self.most, self.skip = variables, patterns, filters, most, skip

    def _with(self, **changes) -> Sparql:
        return Sparql(**({"variables": self.variables, "patterns": self.patterns, "filters": self.filters, "most": self.most, "skip": self.skip} | changes))

    def select(self, *variables: str) -> Sparql:
        return self._with(variables=self.variables + variables)

    def where(self, pattern: str) -> Sparql:
        return self._with(patterns=(*self.patterns, pattern))

    def filter(self, condition: str) -> Sparql:
        return self._with(filters=(*self.filters, condition))

    def limit(self, n: int) -> Sparql:
        return self._with(most=n)

    def offset(self, n: int) -> Sparql:
        return self._with(skip=n)

    def build(self) -> str:
        lines = [f"PREFIX {p}: <{u}>" for p, u in PREFIXES.items()]
        lines += ["", "SELECT " + (" ".join(f"?{v.lstrip('?')}" for v in self.variables) or "*"), "WHERE {"]
        lines += [f"  {p} ." for p in self.patterns] + [f"  FILTER({f})" for f in self.filters] + ["}"]
        lines += [f"LIMIT {self.most}"] * (self.most is not None) + [f"OFFSET {self.skip}"] * (self.skip is not None)
        return "\n".join(lines)


def entity_mentions(uri: str) -> str:
    """SPARQL text for the tokens that mention an entity."""
    return Sparql().select("token", "surface").where(f"?token tok:entity <{uri}>").where("?token tok:surface ?surface").build()


def mentions(rows: DataFrame, uri: str) -> DataFrame:
    """The same over the triples table: (text_id, token_ix, subject, surface) of tokens that mention an entity."""
    named = rows.where((F.col("predicate") == f"<{NAMESPACE}entity>") & (F.col("object") == f"<{uri}>")).select("text_id", "token_ix", "subject")
    surfaces = rows.where(F.col("predicate") == f"<{NAMESPACE}surface>").select("text_id", "token_ix", F.col("object").alias("surface"))
    return named.join(surfaces, ["text_id", "token_ix"])

"""Queries of lattices and paths, over part names without blanks and over Japanese requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsumugi.operators import exports as ex
from tsumugi.operators import lattice as la
from tsumugi.operators import paths as pa
from tsumugi.operators import viterbi as vi
from tsumugi.operators.lexicon import CATEGORIES, ENTRY, GROUPING, KANJI_NUMERALS, NO_CONNECTION, RUNTIME_CONTEXT, SAMPLES, UNKNOWN, UNKNOWN_COST, Lexicon, example_lexicon
from tsumugi.runtime import table

# A lexicon of our own: whole words of part names and shorter words they also divide into.
NAMES = "anvil blue bolt cold gear gizmo hot large new old plate red ring rod small widget".split()
SHORTER = "an vil b lue bo lt c ear lar ge n ew pla te re d r ing ri ng s mall wid get in".split()
WORDS = [(w, i % 4, (i * 7) % 5, 1000 + (i * 7919) % 1013 - 120 * len(w)) for i, w in enumerate(NAMES + SHORTER, 1)]
CELLS = [(r, c, (r * 3571 + c * 1637) % 997 - 300) for r in range(5) for c in range(4) if (r, c) != (4, 3)]
K = 5
MOST_POS = 100  # parts of speech that the example costs connect


def part_lexicon(spark: SparkSession) -> Lexicon:
    return example_lexicon(spark, WORDS, CELLS)


def part_texts(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "part").select(F.col("p_partkey").alias("text_id"), F.replace("p_name", F.lit(" "), F.lit("")).alias("text"))


def part_tokens(spark: SparkSession, base: str, k: int = 1) -> DataFrame:
    return vi.tokenize(part_texts(spark, base), part_lexicon(spark), k)


def viterbi_part_tokens(spark: SparkSession, base: str) -> DataFrame:
    return part_tokens(spark, base).select("text_id", "token_ix", "surface", "wcost", "ccost")


def viterbi_part_costs(spark: SparkSession, base: str) -> DataFrame:
    return part_tokens(spark, base).groupBy("text_id").agg(F.max("path_cost").alias("cost"), F.count(F.lit(1)).alias("n_tokens"))


def wakati_part(spark: SparkSession, base: str) -> DataFrame:
    return vi.wakati(part_tokens(spark, base))


def kbest_part(spark: SparkSession, base: str) -> DataFrame:
    return part_tokens(spark, base, K).groupBy("text_id", "path_no").agg(F.max("path_cost").alias("cost"))


def lattice_nodes_part(spark: SparkSession, base: str) -> DataFrame:
    return la.lattice_nodes(part_texts(spark, base), part_lexicon(spark)).select("text_id", "start_pos", "end_pos", "node_ix", "surface", "wcost")


def lattice_edges_part(spark: SparkSession, base: str) -> DataFrame:
    return la.all_edges(part_texts(spark, base), part_lexicon(spark))


def lattice_stats_part(spark: SparkSession, base: str) -> DataFrame:
    stats = la.lattice_stats(la.lattice_nodes(part_texts(spark, base), part_lexicon(spark)))
    return stats.withColumn("estimated_paths", F.col("estimated_paths").cast("double"))


def best_path_edges_part(spark: SparkSession, base: str) -> DataFrame:
    flagged = pa.flagged_edges(part_texts(spark, base), part_lexicon(spark))
    return flagged.groupBy("text_id").agg(F.count_if("on_best_path").alias("n_on"), F.sum(F.when(F.col("on_best_path"), F.col("ccost") + F.col("wcost"))).alias("cost"))


def what_if_cost(spark: SparkSession, base: str) -> DataFrame:
    return pa.what_if(part_tokens(spark, base), 2, 1, 5000)


def path_analysis_part(spark: SparkSession, base: str) -> DataFrame:
    return pa.path_analysis(part_tokens(spark, base)).drop("path_no")


def path_comparison_part(spark: SparkSession, base: str) -> DataFrame:
    return pa.compare_paths(pa.path_analysis(part_tokens(spark, base, 2))).select("text_id", "prefer_first")


def path_differences_part(spark: SparkSession, base: str) -> DataFrame:
    """Differences in cost and tokens between the two best paths of every distinct part name."""
    names = part_texts(spark, base).groupBy("text").agg(F.min("text_id").alias("text_id"))
    return pa.compare_paths(pa.path_analysis(vi.tokenize(names, part_lexicon(spark), 2)))


def cost_arrays_part(spark: SparkSession, base: str) -> DataFrame:
    """Best predecessor and saturating sums over cost arrays made of the parts' sizes."""
    size = F.col("p_size")
    costs, connections = F.array(size, size * 7 % 50, size * 13 % 50), F.array(size * 3 % 20, size * 5 % 20, size * 11 % 20)
    arrays = table(spark, base, "part").select("p_partkey", costs.cast("array<int>").alias("costs"), connections.cast("array<int>").alias("connections"))
    best = arrays.select("p_partkey", pa.best_predecessor(F.col("costs"), F.col("connections")).alias("b"), pa.add_costs(F.col("costs"), 2147483620).alias("s"))
    return best.select("p_partkey", F.col("b.ix").alias("ix"), F.col("b.cost").alias("cost"), F.element_at("s", 1).alias("first_sum"), F.element_at("s", 3).alias("last_sum"))


def _paths(spark: SparkSession, base: str) -> DataFrame:
    return part_tokens(spark, base).groupBy("text_id").agg(F.sum(F.char_length("surface")).alias("n_chars"), F.count(F.lit(1)).alias("n_tokens"), F.max("path_cost").alias("cost"))


def segmentation_report(spark: SparkSession, base: str) -> DataFrame:
    return pa.segmentation_report(_paths(spark, base))


def token_distribution(spark: SparkSession, base: str) -> DataFrame:
    return pa.token_distribution(_paths(spark, base))


def connection_stats(spark: SparkSession, base: str) -> DataFrame:
    contexts = table(spark, base, "overlay_entries").where("left_id is not null and right_id is not null").groupBy("right_id", "left_id").agg(F.min(F.coalesce("wcost", F.lit(0))).alias("cost"))
    return la.connection_stats(contexts)


def path_diversity_part(spark: SparkSession, base: str) -> DataFrame:
    node = F.concat_ws(":", "start_pos", "surface").alias("n")
    tokens = part_tokens(spark, base, K).select("text_id", "path_no", "token_ix", node).repartition("text_id")  # serves both groupings
    paths = tokens.groupBy("text_id", "path_no").agg(F.array_sort(F.collect_list(F.struct("token_ix", "n"))).getField("n").alias("path"))
    return pa.path_diversity(paths.select(F.col("text_id").alias("graph_id"), F.col("path_no").alias("rank_no"), "path"))


def unknown_nodes_requests(spark: SparkSession, base: str) -> DataFrame:
    """Unknown-word nodes of the requests under an empty lexicon: every run of one category, all prefixes of it."""
    texts = request_texts(spark, base)
    nodes = la.lattice_nodes(texts, Lexicon.of(spark.createDataFrame([], ENTRY)))
    return nodes.groupBy("text_id", "feature").agg(F.count(F.lit(1)).alias("n_nodes"), F.max(F.col("end_pos") - F.col("start_pos")).alias("longest"))


# Templates and a character table of our own: two templates for KANJI, none for SYMBOL; kana of both kinds are one category.
TEMPLATES = [("HIRAGANA", 0, 1, 2, 900, "名詞,未知,かな"), ("KANJI", 0, 2, 1, 700, "名詞,未知,漢字"), ("KANJI", 1, 3, 3, 650, "名詞,未知,別"), ("ALPHA", 0, 1, 1, 800, "名詞,未知,英字"), ("NUMERIC", 0, 2, 2, 300, "名詞,数"), ("DEFAULT", 0, 0, 0, 4000, "記号,未知")]
POINTS = ((0x41, 0x5A, "ALPHA", True), (0x61, 0x7A, "ALPHA", True), (0x30, 0x39, "NUMERIC", True), (0x3041, 0x30FF, "HIRAGANA", True), (0x4E00, 0x9FFF, "KANJI", False), (0x3001, 0x3002, "SYMBOL", True), (0x20, 0x21, "SYMBOL", True))


def template_lexicon(spark: SparkSession) -> Lexicon:
    """The words of the parts with templates for unknown words and a character table."""
    lexicon = part_lexicon(spark)
    unknown = spark.createDataFrame([(k, i, left, right, 9, cost, f) for k, i, left, right, cost, f in TEMPLATES], UNKNOWN)
    ranges = spark.createDataFrame([*POINTS], "lo int, hi int, category string, `group` boolean")
    characters = ranges.select(F.explode(F.sequence("lo", "hi")).alias("codepoint"), "category", "group")
    return Lexicon.of(lexicon.entries, lexicon.connections, unknown, characters)


def unknown_templates_requests(spark: SparkSession, base: str) -> DataFrame:
    """Unknown-word nodes of the requests under templates and a character table."""
    nodes = la.lattice_nodes(request_texts(spark, base), template_lexicon(spark)).where("is_unknown")
    return nodes.groupBy("text_id", "feature").agg(F.count(F.lit(1)).alias("n_nodes"), F.max(F.col("end_pos") - F.col("start_pos")).alias("longest"), F.sum("wcost").alias("cost"))


def request_texts(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "parse_requests").select(F.col("request_id").alias("text_id"), "text").where(F.col("text").isNotNull()).dropDuplicates()


def request_costs(spark: SparkSession, base: str) -> DataFrame:
    """Cost of the best segmentation of every request, unknown words by templates and a character table."""
    return vi.tokenize(request_texts(spark, base), template_lexicon(spark)).select("text_id", F.col("path_cost").alias("cost")).distinct()


def n_best_part(spark: SparkSession, base: str) -> DataFrame:
    """The k best paths of every part as text, over its distinct names."""
    names = part_texts(spark, base).groupBy("text").agg(F.min("text_id").alias("text_id"))
    return ex.n_best(vi.tokenize(names, part_lexicon(spark), 2))


def dot_part(spark: SparkSession, base: str) -> DataFrame:
    """The lattice of every distinct part name as a graph description."""
    names = part_texts(spark, base).groupBy("text").agg(F.min("text_id").alias("text_id")).select("text_id", "text")
    lexicon = part_lexicon(spark)
    nodes = la.lattice_nodes(names, lexicon)
    return ex.dot(nodes, la.lattice_edges(nodes, names, lexicon))


def search_entries_part(spark: SparkSession, base: str) -> DataFrame:
    """Cost up to every node of the lattices of the distinct part names."""
    names = part_texts(spark, base).groupBy("text").agg(F.min("text_id").alias("text_id"))
    return la.search_entries(names, part_lexicon(spark)).select("text_id", "end_pos", "node_ix", F.col("cumulative_cost").alias("cost"))


def lexicon_info(spark: SparkSession, base: str) -> DataFrame:
    """Sizes of the lexicon of the requests."""
    return request_lexicon(spark, base).info()


def k_shortest_part(spark: SparkSession, base: str) -> DataFrame:
    """The k cheapest paths through the lattice of every distinct part name, by the general search over edge tables."""
    return _k_shortest(spark, base)


def _k_shortest(spark: SparkSession, base: str, backward: bool = False) -> DataFrame:
    names = part_texts(spark, base).groupBy("text").agg(F.min("text_id").alias("text_id")).select("text_id", "text")
    lexicon = part_lexicon(spark)
    edges = la.lattice_edges(la.lattice_nodes(names, lexicon), names, lexicon)
    node = lambda end, ix: F.when((F.col(end) == 0) & (F.col(ix) == -1), 0).when(F.col(ix) == -1, 1).otherwise(F.col(end) * 1000 + F.col(ix) + 2)
    steps = edges.select(F.col("text_id").alias("graph_id"), node("from_end", "from_ix").alias("src"), node("to_end", "to_ix").alias("dst"), F.col("ccost").alias("cost"), "wcost")
    costs = steps.select("graph_id", F.col("dst").alias("node"), F.col("wcost").alias("cost")).distinct()
    starts = names.select(F.col("text_id").alias("graph_id"), F.lit(0).alias("node"), F.lit(0).alias("cost"))
    return pa.k_shortest(costs.unionByName(starts), steps.drop("wcost"), 0, 1, K, backward=backward).select("graph_id", "rank_no", "cost")


def k_shortest_backward_part(spark: SparkSession, base: str) -> DataFrame:
    """The same grown from the end."""
    return _k_shortest(spark, base, backward=True)


def request_lexicon(spark: SparkSession, base: str) -> Lexicon:
    """Words of the analysed requests, with run-time words and connection costs by part of speech.

    A word without a cost costs 0, a run-time word without context ids has RUNTIME_CONTEXT.
    """
    morphemes = table(spark, base, "morphemes").where(F.col("word_id") != 4294967295)
    words = morphemes.groupBy("surface", "word_id", "pos_id").agg(F.coalesce(F.min("wcost"), F.lit(0)).alias("wcost"), F.min("feature").alias("feature"))
    entries = words.select("surface", "word_id", F.col("pos_id").alias("left_id"), F.col("pos_id").alias("right_id"), "pos_id", "wcost", "feature", F.lit(1).alias("layer"))
    overlay = table(spark, base, "overlay_entries").where("surface <> ''").groupBy("surface").agg(F.max_by(F.struct("left_id", "right_id", "wcost", "feature"), F.struct("updated_at", "overlay_id")).alias("e"))
    added = overlay.select("surface", F.lit(None).cast("long").alias("word_id"), F.coalesce("e.left_id", F.lit(RUNTIME_CONTEXT)).alias("left_id"), F.coalesce("e.right_id", F.lit(RUNTIME_CONTEXT)).alias("right_id"), F.lit(0).alias("pos_id"), F.coalesce("e.wcost", F.lit(0)).alias("wcost"), F.coalesce("e.feature", F.lit("*")).alias("feature"), F.lit(0).alias("layer"))
    costs = (F.col("right_id") * 31 + F.col("left_id") * 17) % 211
    numbers = spark.range(0, MOST_POS).select(F.col("id").cast("int").alias("right_id"), F.explode(F.sequence(F.lit(0), F.lit(MOST_POS - 1))).alias("left_id"))
    return Lexicon.of(entries, numbers.withColumn("cost", costs)).with_entries(added)


def tokenize_requests(spark: SparkSession, base: str) -> DataFrame:
    texts = table(spark, base, "parse_requests").select(F.col("request_id").alias("text_id"), "text").dropDuplicates()
    return vi.tokenize(texts, request_lexicon(spark, base)).select("text_id", "token_ix", "surface", "word_id", "pos_id", "wcost", "is_unknown", "path_cost")


def tokenize_costs(spark: SparkSession, base: str) -> DataFrame:
    """Cost of the best segmentation of every request under the words of the analysed requests."""
    return vi.tokenize(request_texts(spark, base), request_lexicon(spark, base)).groupBy("text_id").agg(F.max("path_cost").alias("cost"))


_WORDS = ", ".join(f"('{w}', {left}, {right}, {cost})" for w, left, right, cost in WORDS)
_CELLS = ", ".join(f"({r}, {c}, {cost})" for r, c, cost in CELLS)
PATHS_SQL = f"""
WITH RECURSIVE words(w, lid, rid, wcost) AS (VALUES {_WORDS}), cells(rid, lid, cost) AS (VALUES {_CELLS}),
texts AS (SELECT p_partkey AS text_id, replace(p_name, ' ', '') AS text FROM part),
bodies AS (SELECT DISTINCT text FROM texts),
spots AS (SELECT text, unnest(range(length(text))) AS st FROM bodies),
known AS (SELECT s.text, s.st, d.w, d.lid, d.rid, d.wcost FROM spots s JOIN words d ON substr(s.text, s.st + 1, length(d.w)) = d.w),
bare AS (SELECT s.* FROM spots s ANTI JOIN known k USING (text, st)),
nodes AS (SELECT * FROM known UNION ALL SELECT text, st, substr(text, st + 1, e - st), 0, 0, {UNKNOWN_COST} FROM (SELECT text, st, unnest(range(st + 1, length(text) + 1)) AS e FROM bare)),
walk(text, pos, rid, cost, toks) AS (
  SELECT text, 0, 0, 0, []::STRUCT(w VARCHAR, beg INTEGER, wcost INTEGER, ccost INTEGER, lid INTEGER, rid INTEGER)[] FROM bodies
  UNION ALL
  SELECT k.text, k.pos + length(d.w), d.rid, k.cost + coalesce(c.cost, {NO_CONNECTION}) + d.wcost,
    list_append(k.toks, {{'w': d.w, 'beg': k.pos, 'wcost': d.wcost, 'ccost': coalesce(c.cost, {NO_CONNECTION}), 'lid': d.lid, 'rid': d.rid}})
  FROM walk k JOIN nodes d ON d.text = k.text AND d.st = k.pos LEFT JOIN cells c ON c.rid = k.rid AND c.lid = d.lid
),
whole AS (SELECT k.text, k.cost + coalesce(c.cost, {NO_CONNECTION}) AS cost, k.toks FROM walk k LEFT JOIN cells c ON c.rid = k.rid AND c.lid = 0 WHERE k.pos = length(k.text) AND k.pos > 0),
ranked AS (SELECT text, cost, toks, row_number() OVER (PARTITION BY text ORDER BY cost) AS path_no FROM whole),
best AS (SELECT t.text_id, t.text, r.cost, r.toks FROM texts t JOIN ranked r USING (text) WHERE r.path_no = 1),
tokens AS (SELECT text_id, cost AS path_cost, unnest(toks) AS t, unnest(range(len(toks))) AS token_ix, len(toks) AS n FROM best)
"""
NODES_SQL = f"""
WITH words(w, lid, rid, wcost) AS (VALUES {_WORDS}), numbered AS (SELECT *, row_number() OVER () - 1 AS word_id FROM words),
texts AS (SELECT p_partkey AS text_id, replace(p_name, ' ', '') AS text FROM part),
spots AS (SELECT text_id, text, unnest(range(length(text))) AS start_pos FROM texts),
known AS (SELECT s.text_id, s.start_pos, s.start_pos + length(d.w) AS end_pos, d.w AS surface, d.lid, d.rid, d.wcost, d.word_id, false AS u FROM spots s JOIN numbered d ON substr(s.text, s.start_pos + 1, length(d.w)) = d.w),
bare AS (SELECT s.* FROM spots s ANTI JOIN known k USING (text_id, start_pos)),
unknown AS (SELECT text_id, start_pos, e AS end_pos, substr(text, start_pos + 1, e - start_pos) AS surface, 0 AS lid, 0 AS rid, {UNKNOWN_COST} AS wcost, NULL AS word_id, true AS u FROM (SELECT *, unnest(range(start_pos + 1, length(text) + 1)) AS e FROM bare)),
nodes AS (SELECT *, row_number() OVER (PARTITION BY text_id, end_pos ORDER BY start_pos, u, coalesce(word_id, -1)) - 1 AS node_ix FROM (SELECT * FROM known UNION ALL SELECT * FROM unknown))
"""
_CATEGORY = f"CASE WHEN contains('{KANJI_NUMERALS}', c) THEN 'KANJINUMERIC' " + " ".join(f"WHEN unicode(c) BETWEEN {lo} AND {hi} THEN '{name}'" for lo, hi, name in CATEGORIES) + " ELSE 'DEFAULT' END"
_GROUPING = ", ".join(f"'{g}'" for g in sorted(GROUPING))

_SAMPLES = ", ".join(f"('{kind}', '{c}')" for kind, c in SAMPLES.items())
_POINTS = ", ".join(f"({lo}, {hi}, '{kind}', {group})" for lo, hi, kind, group in POINTS)
_TEMPLATES = ", ".join(f"('{kind}', {i}, {left}, {right}, {cost}, '{f}')" for kind, i, left, right, cost, f in TEMPLATES)
# Nodes of the requests under the words of the parts, the templates and the character table.
REQUEST_NODES_SQL = f"""
WITH RECURSIVE words(w, lid, rid, wcost) AS (VALUES {_WORDS}), cells(rid, lid, cost) AS (VALUES {_CELLS}), points(lo, hi, cat, grp) AS (VALUES {_POINTS}), templates(cat, ix, lid, rid, wcost, feature) AS (VALUES {_TEMPLATES}), samples(cat, c) AS (VALUES {_SAMPLES}),
grouping_cats AS (SELECT s.cat FROM samples s JOIN points p ON unicode(s.c) BETWEEN p.lo AND p.hi WHERE p.grp),
t AS (SELECT DISTINCT request_id AS text_id, text FROM parse_requests WHERE text IS NOT NULL),
spots AS (SELECT text_id, text, i, substr(text, i + 1, 1) AS c FROM (SELECT text_id, text, unnest(range(length(text))) AS i FROM t)),
k AS (SELECT s.*, coalesce(p.cat, 'DEFAULT') AS cat FROM spots s LEFT JOIN points p ON unicode(s.c) BETWEEN p.lo AND p.hi),
b AS (SELECT *, CASE WHEN lag(cat) OVER (PARTITION BY text_id ORDER BY i) = cat THEN 0 ELSE 1 END AS b FROM k),
g AS (SELECT *, sum(b) OVER (PARTITION BY text_id ORDER BY i) AS isl FROM b),
r AS (SELECT *, max(i) OVER (PARTITION BY text_id, isl) - i + 1 AS run FROM g),
known AS (SELECT s.text_id, s.i AS st, s.i + length(d.w) AS en, d.lid, d.rid, d.wcost FROM spots s JOIN words d ON substr(s.text, s.i + 1, length(d.w)) = d.w),
bare AS (SELECT r.* FROM r ANTI JOIN known k ON k.text_id = r.text_id AND k.st = r.i),
unknown AS (
  SELECT b.text_id, b.i AS st, b.i + n AS en, coalesce(x.lid, 0) AS lid, coalesce(x.rid, 0) AS rid, coalesce(x.wcost, {UNKNOWN_COST}) AS wcost, coalesce(x.feature, '未知語,' || b.cat) AS feature
  FROM (SELECT *, unnest(range(1, CASE WHEN cat IN (SELECT cat FROM grouping_cats) THEN run ELSE 1 END + 1)) AS n FROM bare) b LEFT JOIN templates x ON x.cat = b.cat AND (n = 1 OR x.ix = 0)
)
"""

QUERIES = {
    f.__name__: f
    for f in (viterbi_part_tokens, viterbi_part_costs, wakati_part, kbest_part, lattice_nodes_part, lattice_edges_part, lattice_stats_part, best_path_edges_part, what_if_cost, path_analysis_part)
    + (path_comparison_part, segmentation_report, token_distribution, connection_stats, path_diversity_part, unknown_nodes_requests, tokenize_requests)
    + (unknown_templates_requests, request_costs, n_best_part, dot_part, k_shortest_part, tokenize_costs, search_entries_part, lexicon_info, path_differences_part, cost_arrays_part, k_shortest_backward_part)
}
SQL = {
    "viterbi_part_tokens": PATHS_SQL + "SELECT text_id, token_ix, t.w AS surface, t.wcost AS wcost, t.ccost AS ccost FROM tokens",
    "viterbi_part_costs": PATHS_SQL + "SELECT text_id, cost, len(toks) AS n_tokens FROM best",
    "wakati_part": PATHS_SQL + "SELECT text_id, array_to_string(list_transform(toks, lambda x: x.w), ' ') AS wakati FROM best",
    "kbest_part": PATHS_SQL + f"SELECT text_id, path_no, cost FROM texts JOIN ranked USING (text) WHERE path_no <= {K}",
    "lattice_nodes_part": NODES_SQL + "SELECT text_id, start_pos, end_pos, node_ix, surface, wcost FROM nodes",
    "lattice_edges_part": NODES_SQL + f""", cells(rid, lid, cost) AS (VALUES {_CELLS}),
a AS (SELECT text_id, end_pos AS from_end, node_ix AS from_ix, rid FROM nodes UNION ALL SELECT text_id, 0, -1, 0 FROM texts),
b AS (SELECT text_id, start_pos, end_pos AS to_end, node_ix AS to_ix, lid, wcost FROM nodes UNION ALL SELECT text_id, length(text), length(text) + 1, -1, 0, 0 FROM texts)
SELECT a.text_id, from_end, from_ix, to_end, to_ix, coalesce(c.cost, {NO_CONNECTION}) AS ccost, wcost FROM a JOIN b ON a.text_id = b.text_id AND a.from_end = b.start_pos LEFT JOIN cells c ON c.rid = a.rid AND c.lid = b.lid""",
    "lattice_stats_part": NODES_SQL + "SELECT text_id, sum(n)::BIGINT AS n_nodes, count(*) AS n_positions, max(n) AS most_nodes, avg(n) AS mean_nodes, product(n) AS estimated_paths FROM (SELECT text_id, end_pos, count(*) AS n FROM nodes GROUP BY ALL) GROUP BY text_id",
    "best_path_edges_part": PATHS_SQL + "SELECT text_id, len(toks) + 1 AS n_on, cost FROM best",
    "what_if_cost": PATHS_SQL + """SELECT text_id, 1 AS path_no, any_value(path_cost) + sum(CASE WHEN prev = 2 AND t.lid = 1 THEN 5000 - t.ccost ELSE 0 END)::BIGINT AS path_cost
FROM (SELECT *, coalesce(lag(t.rid) OVER (PARTITION BY text_id ORDER BY token_ix), 0) AS prev FROM tokens) GROUP BY text_id""",
    "path_analysis_part": PATHS_SQL + """SELECT text_id, count(*) AS n_tokens, sum(t.wcost + t.ccost)::BIGINT AS total_cost, sum(t.wcost)::BIGINT AS word_cost, sum(t.ccost)::BIGINT AS connection_cost, avg(t.wcost + t.ccost) AS avg_cost,
arg_max(t.w, (t.wcost + t.ccost) * 1000 + token_ix) AS dearest, arg_min(t.w, (t.wcost + t.ccost) * 1000 + token_ix) AS cheapest,
CASE WHEN sum(t.ccost) = 0 THEN 'infinity'::DOUBLE ELSE sum(t.wcost) / sum(t.ccost)::DOUBLE END AS word_connection_ratio FROM tokens GROUP BY text_id""",
    "path_differences_part": PATHS_SQL + """, first AS (SELECT text, min(text_id) AS text_id FROM texts GROUP BY text), two AS (SELECT text, path_no, list_sum(list_transform(toks, lambda x: x.wcost + x.ccost)) AS c, len(toks) AS n FROM ranked WHERE path_no <= 2)
SELECT text_id, (a.c - b.c)::BIGINT AS cost_diff, a.n - b.n AS token_diff, a.c < b.c AS prefer_first FROM first JOIN two a USING (text) JOIN two b USING (text) WHERE a.path_no = 1 AND b.path_no = 2""",
    "cost_arrays_part": """WITH a AS (SELECT p_partkey, [p_size, p_size * 7 % 50, p_size * 13 % 50] AS c, [p_size * 3 % 20, p_size * 5 % 20, p_size * 11 % 20] AS k FROM part), s AS (SELECT p_partkey, c, [c[1] + k[1], c[2] + k[2], c[3] + k[3]] AS t FROM a)
SELECT p_partkey, list_position(t, list_min(t)) - 1 AS ix, list_min(t) AS cost, least(2147483647, c[1]::BIGINT + 2147483620) AS first_sum, least(2147483647, c[3]::BIGINT + 2147483620) AS last_sum FROM s""",
    "path_comparison_part": PATHS_SQL + """, two AS (SELECT text, path_no, list_sum(list_transform(toks, lambda x: x.wcost + x.ccost)) AS c FROM ranked WHERE path_no <= 2)
SELECT text_id, a.c < b.c AS prefer_first FROM texts JOIN two a USING (text) JOIN two b USING (text) WHERE a.path_no = 1 AND b.path_no = 2""",
    "segmentation_report": PATHS_SQL + """SELECT count(*) AS n_texts, sum(len(toks))::BIGINT AS n_tokens, sum(length(text))::BIGINT AS n_chars, sum(cost)::BIGINT AS total_cost,
sum(len(toks)) / count(*)::DOUBLE AS tokens_per_text, sum(length(text)) / sum(len(toks))::DOUBLE AS chars_per_token, sum(cost) / sum(len(toks))::DOUBLE AS cost_per_token FROM best""",
    "token_distribution": PATHS_SQL + ", d AS (SELECT len(toks) AS n, count(*) AS c FROM best GROUP BY 1) SELECT r.n AS n_tokens, coalesce(d.c, 0) AS n_texts FROM (SELECT unnest(range((SELECT max(n) FROM d) + 1)) AS n) r LEFT JOIN d USING (n)",
    "connection_stats": """WITH c AS (SELECT right_id, left_id, min(coalesce(wcost, 0)) AS cost FROM overlay_entries WHERE left_id IS NOT NULL AND right_id IS NOT NULL GROUP BY ALL)
SELECT min(cost) AS min_cost, max(cost) AS max_cost, avg(cost) AS avg_cost, count(*) FILTER (cost = 0) AS n_zero, count(*) FILTER (cost = 0) / count(*)::DOUBLE AS sparsity FROM c""",
    "path_diversity_part": PATHS_SQL + f""", p AS (SELECT text_id, path_no, list_transform(toks, lambda x: x.beg || ':' || x.w) AS path FROM texts JOIN ranked USING (text) WHERE path_no <= {K}),
n AS (SELECT text_id, count(DISTINCT v) AS n_nodes FROM (SELECT text_id, unnest(path) AS v FROM p) GROUP BY text_id),
e AS (SELECT text_id, count(DISTINCT v) AS n_edges FROM (SELECT text_id, unnest(list_zip(path[:-2], path[2:])) AS v FROM p WHERE len(path) > 1) GROUP BY text_id),
d AS (SELECT a.text_id, avg(1 - len(list_intersect(a.path, b.path)) / len(list_distinct(list_concat(a.path, b.path)))::DOUBLE) AS m FROM p a JOIN p b ON a.text_id = b.text_id AND a.path_no < b.path_no GROUP BY a.text_id)
SELECT n.text_id AS graph_id, n_nodes, coalesce(n_edges, 0) AS n_edges, coalesce(m, 0.0) AS mean_distance FROM n LEFT JOIN e USING (text_id) LEFT JOIN d USING (text_id)""",
    "unknown_templates_requests": REQUEST_NODES_SQL + "SELECT text_id, feature, count(*) AS n_nodes, max(en - st) AS longest, sum(wcost)::BIGINT AS cost FROM unknown GROUP BY ALL",
    "request_costs": REQUEST_NODES_SQL + f""",
nodes AS (SELECT text_id, st, en, lid, rid, min(wcost) AS wcost FROM (SELECT text_id, st, en, lid, rid, wcost FROM known UNION ALL SELECT text_id, st, en, lid, rid, wcost FROM unknown) GROUP BY ALL),
rights AS (SELECT DISTINCT rid FROM nodes UNION SELECT 0), lefts AS (SELECT DISTINCT lid FROM nodes UNION SELECT 0),
price AS (SELECT r.rid, l.lid, coalesce(c.cost, {NO_CONNECTION}) AS cost FROM rights r CROSS JOIN lefts l LEFT JOIN cells c ON c.rid = r.rid AND c.lid = l.lid),
walk(text_id, pos, rid, cost) USING KEY (text_id, pos, rid) AS (
  SELECT text_id, 0::BIGINT, 0, 0::BIGINT FROM t WHERE text <> ''
  UNION
  SELECT n.text_id, n.en, n.rid, min(w.cost + p.cost + n.wcost) AS cost FROM walk w JOIN nodes n ON n.text_id = w.text_id AND n.st = w.pos JOIN price p ON p.rid = w.rid AND p.lid = n.lid
  LEFT JOIN recurring.walk o ON o.text_id = n.text_id AND o.pos = n.en AND o.rid = n.rid
  GROUP BY n.text_id, n.en, n.rid HAVING min(w.cost + p.cost + n.wcost) < min(coalesce(o.cost, 9e15::BIGINT))
)
SELECT t.text_id, min(w.cost + p.cost)::BIGINT AS cost FROM t JOIN walk w ON w.text_id = t.text_id AND w.pos = length(t.text) JOIN price p ON p.rid = w.rid AND p.lid = 0 WHERE t.text <> '' GROUP BY t.text_id""",
    "tokenize_costs": f"""
WITH RECURSIVE t AS (SELECT DISTINCT request_id AS text_id, text FROM parse_requests WHERE text IS NOT NULL AND text <> ''),
words AS (
  SELECT surface AS w, coalesce(pos_id, -1) AS lid, coalesce(pos_id, -1) AS rid, coalesce(min(wcost), 0) AS wcost FROM morphemes WHERE word_id <> 4294967295 AND surface <> '' GROUP BY surface, word_id, pos_id
  UNION ALL SELECT surface, coalesce(left_id, {RUNTIME_CONTEXT}), coalesce(right_id, {RUNTIME_CONTEXT}), coalesce(wcost, 0) FROM (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY updated_at DESC NULLS LAST, overlay_id DESC) AS r FROM overlay_entries WHERE surface <> '') WHERE r = 1),
spots AS (SELECT text_id, text, i, substr(text, i + 1, 1) AS c FROM (SELECT text_id, text, unnest(range(length(text))) AS i FROM t)),
k AS (SELECT *, {_CATEGORY} AS cat FROM spots), b AS (SELECT *, CASE WHEN lag(cat) OVER (PARTITION BY text_id ORDER BY i) = cat THEN 0 ELSE 1 END AS b FROM k),
g AS (SELECT *, sum(b) OVER (PARTITION BY text_id ORDER BY i) AS isl FROM b), r AS (SELECT *, max(i) OVER (PARTITION BY text_id, isl) - i + 1 AS run FROM g),
keys AS (SELECT text_id, i, substr(text, i + 1, n) AS w, n FROM (SELECT *, unnest(range(1, (SELECT max(length(w)) FROM words) + 1)) AS n FROM spots) WHERE i + n <= length(text)),
known AS (SELECT text_id, i AS st, i + n AS en, lid, rid, wcost FROM keys JOIN words USING (w)),
bare AS (SELECT r.* FROM r ANTI JOIN known k ON k.text_id = r.text_id AND k.st = r.i),
unknown AS (SELECT text_id, i AS st, i + n AS en, 0 AS lid, 0 AS rid, {UNKNOWN_COST} AS wcost FROM (SELECT *, unnest(range(1, CASE WHEN cat IN ({_GROUPING}) THEN run ELSE 1 END + 1)) AS n FROM bare)),
nodes AS (SELECT text_id, st, en, lid, rid, min(wcost) AS wcost FROM (SELECT * FROM known UNION ALL SELECT * FROM unknown) GROUP BY ALL),
rights AS (SELECT DISTINCT rid FROM nodes UNION SELECT 0), lefts AS (SELECT DISTINCT lid FROM nodes UNION SELECT 0),
price AS (SELECT rid, lid, CASE WHEN rid BETWEEN 0 AND {MOST_POS - 1} AND lid BETWEEN 0 AND {MOST_POS - 1} THEN (rid * 31 + lid * 17) % 211 ELSE {NO_CONNECTION} END AS cost FROM rights CROSS JOIN lefts),
walk(text_id, pos, rid, cost) USING KEY (text_id, pos, rid) AS (
  SELECT text_id, 0::BIGINT, 0, 0::BIGINT FROM t
  UNION
  SELECT n.text_id, n.en, n.rid, min(w.cost + p.cost + n.wcost) AS cost FROM walk w JOIN nodes n ON n.text_id = w.text_id AND n.st = w.pos JOIN price p ON p.rid = w.rid AND p.lid = n.lid
  LEFT JOIN recurring.walk o ON o.text_id = n.text_id AND o.pos = n.en AND o.rid = n.rid
  GROUP BY n.text_id, n.en, n.rid HAVING min(w.cost + p.cost + n.wcost) < min(coalesce(o.cost, 9e15::BIGINT))
)
SELECT t.text_id, min(w.cost + p.cost)::BIGINT AS cost FROM t JOIN walk w ON w.text_id = t.text_id AND w.pos = length(t.text) JOIN price p ON p.rid = w.rid AND p.lid = 0 GROUP BY t.text_id""",
    "n_best_part": PATHS_SQL + """, first AS (SELECT text, min(text_id) AS text_id FROM texts GROUP BY text),
lines AS (SELECT text, path_no, cost, array_to_string(list_transform(toks, lambda x: x.w || chr(9) || CASE WHEN x.wcost = 10000 THEN '未知語,ALPHA' ELSE '名詞,一般,*,*,*,*,' || x.w || ',' || x.w || ',' || x.w END), chr(10)) AS body FROM ranked WHERE path_no <= 2)
SELECT text_id, string_agg('# ' || path_no || ' (cost=' || cost || ')' || chr(10) || body || chr(10) || 'EOS' || chr(10), '' ORDER BY path_no) AS n_best FROM first JOIN lines USING (text) GROUP BY text_id""",
    "dot_part": NODES_SQL + f""", cells(rid, lid, cost) AS (VALUES {_CELLS}), first AS (SELECT min(text_id) AS text_id, length(text) AS n FROM texts GROUP BY text), own AS (SELECT n.* FROM nodes n JOIN first USING (text_id)),
a AS (SELECT text_id, end_pos AS e, node_ix::VARCHAR AS ix, rid FROM own UNION ALL SELECT text_id, 0, 'b', 0 FROM first),
b AS (SELECT text_id, start_pos, end_pos AS e, node_ix::VARCHAR AS ix, lid FROM own UNION ALL SELECT text_id, n, n + 1, 'b', 0 FROM first),
l AS (
  SELECT text_id, 0 AS k, '  n' || end_pos || '_' || node_ix || ' [label="' || surface || chr(92) || 'ncost=' || wcost || '", shape=box' || CASE WHEN u THEN ', style=filled, fillcolor=yellow' ELSE '' END || '];' AS line FROM own
  UNION ALL SELECT text_id, 0, '  n0_b [label="BOS", shape=diamond];' FROM first UNION ALL SELECT text_id, 0, '  n' || (n + 1) || '_b [label="EOS", shape=diamond];' FROM first
  UNION ALL SELECT a.text_id, 1, '  n' || a.e || '_' || a.ix || ' -> n' || b.e || '_' || b.ix || ' [label="' || coalesce(c.cost, {NO_CONNECTION}) || '"];' FROM a JOIN b ON a.text_id = b.text_id AND a.e = b.start_pos LEFT JOIN cells c ON c.rid = a.rid AND c.lid = b.lid)
SELECT text_id, 'digraph lattice {{' || chr(10) || '  rankdir=LR;' || chr(10) || string_agg(line, chr(10) ORDER BY k, line) || chr(10) || '}}' || chr(10) AS dot FROM l GROUP BY text_id""",
    "search_entries_part": NODES_SQL.replace("WITH words", "WITH RECURSIVE words", 1) + f""", cells(rid, lid, cost) AS (VALUES {_CELLS}), first AS (SELECT min(text_id) AS text_id FROM texts GROUP BY text), own AS (SELECT n.* FROM nodes n JOIN first USING (text_id)),
walk(text_id, pos, ix, rid, cost) USING KEY (text_id, pos, ix) AS (
  SELECT text_id, 0::BIGINT, -1::BIGINT, 0, 0::BIGINT FROM first
  UNION
  SELECT n.text_id, n.end_pos, n.node_ix, any_value(n.rid), min(w.cost + coalesce(c.cost, {NO_CONNECTION}) + n.wcost) FROM walk w JOIN own n ON n.text_id = w.text_id AND n.start_pos = w.pos LEFT JOIN cells c ON c.rid = w.rid AND c.lid = n.lid
  LEFT JOIN recurring.walk o ON o.text_id = n.text_id AND o.pos = n.end_pos AND o.ix = n.node_ix
  GROUP BY n.text_id, n.end_pos, n.node_ix HAVING min(w.cost + coalesce(c.cost, {NO_CONNECTION}) + n.wcost) < min(coalesce(o.cost, 9e15::BIGINT))
)
SELECT text_id, pos AS end_pos, ix AS node_ix, cost FROM walk WHERE ix >= 0""",
    "lexicon_info": f"""WITH m AS (SELECT DISTINCT surface, word_id, pos_id FROM morphemes WHERE word_id <> 4294967295), o AS (SELECT DISTINCT surface FROM overlay_entries WHERE surface <> ''), a AS (SELECT surface, 1 AS layer FROM m UNION ALL SELECT surface, 0 FROM o)
SELECT count(*) AS n_entries, count(DISTINCT surface) AS n_surfaces, count(*) FILTER (layer = 0) AS n_runtime, {MOST_POS}::BIGINT AS n_right_ids, {MOST_POS}::BIGINT AS n_left_ids, {MOST_POS * MOST_POS}::BIGINT AS n_cells, 0::BIGINT AS n_templates, 0::BIGINT AS n_categories FROM a""",
    "k_shortest_part": PATHS_SQL + f", first AS (SELECT text, min(text_id) AS graph_id FROM texts GROUP BY text) SELECT graph_id, path_no AS rank_no, cost FROM first JOIN ranked USING (text) WHERE path_no <= {K}",
    "k_shortest_backward_part": PATHS_SQL + f", first AS (SELECT text, min(text_id) AS graph_id FROM texts GROUP BY text) SELECT graph_id, path_no AS rank_no, cost FROM first JOIN ranked USING (text) WHERE path_no <= {K}",
    "unknown_nodes_requests": f"""
WITH t AS (SELECT DISTINCT request_id AS text_id, text FROM parse_requests WHERE text IS NOT NULL),
c AS (SELECT text_id, i, substr(text, i + 1, 1) AS c FROM (SELECT text_id, text, unnest(range(length(text))) AS i FROM t)),
k AS (SELECT text_id, i, {_CATEGORY} AS cat FROM c),
s AS (SELECT *, CASE WHEN lag(cat) OVER (PARTITION BY text_id ORDER BY i) = cat THEN 0 ELSE 1 END AS b FROM k),
g AS (SELECT *, sum(b) OVER (PARTITION BY text_id ORDER BY i) AS isl FROM s),
r AS (SELECT *, max(i) OVER (PARTITION BY text_id, isl) - i + 1 AS run FROM g),
n AS (SELECT text_id, cat, CASE WHEN cat IN ({_GROUPING}) THEN run ELSE 1 END AS m FROM r)
SELECT text_id, '未知語,' || cat AS feature, sum(m)::BIGINT AS n_nodes, max(m) AS longest FROM n GROUP BY ALL""",
}

"""Analysis of best paths, and k shortest paths over edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsumugi.operators.lattice import joined_nodes, lattice_edges, text_edges
from tsumugi.operators.lexicon import Lexicon
from tsumugi.operators.solver import MOST_ENTRIES, Words
from tsumugi.operators.viterbi import tokenize
from tsumugi.runtime import durable

MOST_EDGES = 1_000_000  # of one graph that is searched in one task


def path_analysis(tokens: DataFrame) -> DataFrame:
    """Per path: cost sums, mean, dearest (last of equals) and cheapest (first of equals) token, and ratio."""
    total = F.col("wcost") + F.col("ccost")
    word, connection = F.sum("wcost"), F.sum("ccost")
    return tokens.groupBy("text_id", "path_no").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.sum(total).cast("long").alias("total_cost"), word.alias("word_cost"), connection.alias("connection_cost"), F.avg(total).alias("avg_cost"),
        F.max_by("surface", F.struct(total, "token_ix")).alias("dearest"), F.min_by("surface", F.struct(total, "token_ix")).alias("cheapest"),
        F.when(connection == 0, F.lit(float("inf"))).otherwise(word / connection).alias("word_connection_ratio"),
    )


def compare_paths(analysis: DataFrame, a: int = 1, b: int = 2) -> DataFrame:
    """Differences in cost and tokens between two paths of each text; the first is preferred if it is cheaper."""
    left = analysis.where(F.col("path_no") == a).select("text_id", F.col("total_cost").alias("a_cost"), F.col("n_tokens").alias("a_tokens"))
    right = analysis.where(F.col("path_no") == b).select("text_id", F.col("total_cost").alias("b_cost"), F.col("n_tokens").alias("b_tokens"))
    both = left.join(right, "text_id")
    difference = F.col("a_cost") - F.col("b_cost")
    return both.select("text_id", difference.alias("cost_diff"), (F.col("a_tokens") - F.col("b_tokens")).alias("token_diff"), (difference < 0).alias("prefer_first"))


def what_if(tokens: DataFrame, right_id: int, left_id: int, cost: int) -> DataFrame:
    """Cost of each path if one pair of ids connected at another cost; the path is not solved anew."""
    order = Window.partitionBy("text_id", "path_no").orderBy("token_ix")
    before = F.coalesce(F.lag("right_id").over(order), F.lit(0))
    priced = tokens.withColumn("_c", F.when((before == right_id) & (F.col("left_id") == left_id), cost).otherwise(F.col("ccost")))
    whole = priced.groupBy("text_id", "path_no").agg(F.first("path_cost").alias("path_cost"), F.sum(F.col("_c") - F.col("ccost")).alias("_d"))
    return whole.select("text_id", "path_no", (F.col("path_cost") + F.col("_d")).alias("path_cost"))


def flagged_edges(texts: DataFrame, lexicon: Lexicon, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """All edges of (text_id, text) with a flag for those on the best path: read along the texts if the lexicon fits into a task, joined else."""
    words = Words.fitting(lexicon, most_entries)
    if words is not None:
        return text_edges(texts, words)
    nodes = joined_nodes(texts, lexicon)
    return best_path_edges(lattice_edges(nodes, texts, lexicon), tokenize(texts, lexicon, most_entries=most_entries), nodes)


def best_path_edges(edges: DataFrame, tokens: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with a flag for those on the best path of their text. All sides grow with the texts: none is broadcast."""
    spans = tokens.where(F.col("path_no") == 1).select("text_id", "start_pos", "end_pos", "left_id", "right_id", "wcost", "feature")
    on = nodes.hint("merge").join(spans, ["text_id", "start_pos", "end_pos", "left_id", "right_id", "wcost", "feature"]).groupBy("text_id", "start_pos", "end_pos").agg(F.min("node_ix").alias("ix"))
    into = on.select("text_id", F.col("end_pos").alias("to_end"), F.col("ix").alias("to_ix"), F.lit(1).alias("_to"))
    out = on.select("text_id", F.col("end_pos").alias("from_end"), F.col("ix").alias("from_ix"), F.lit(1).alias("_from"))
    joined = edges.join(into.hint("merge"), ["text_id", "to_end", "to_ix"], "left").join(out.hint("merge"), ["text_id", "from_end", "from_ix"], "left")
    begins, ends = F.col("from_ix") == -1, F.col("to_ix") == -1
    return joined.withColumn("on_best_path", (F.col("_from").isNotNull() | begins) & (F.col("_to").isNotNull() | ends)).drop("_from", "_to")


def segmentation_report(paths: DataFrame) -> DataFrame:
    """Totals and ratios over (n_chars, n_tokens, cost) of texts; ratios are 0 over nothing."""
    over = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    texts, tokens, chars, cost = F.count(F.lit(1)), F.sum("n_tokens"), F.sum("n_chars"), F.sum("cost")
    return paths.agg(
        texts.alias("n_texts"), F.coalesce(tokens, F.lit(0)).alias("n_tokens"), F.coalesce(chars, F.lit(0)).alias("n_chars"), F.coalesce(cost, F.lit(0)).alias("total_cost"),
        over(tokens, texts).alias("tokens_per_text"), over(chars, tokens).alias("chars_per_token"), over(cost, tokens).alias("cost_per_token"),
    )


def token_distribution(paths: DataFrame) -> DataFrame:
    """Texts by number of tokens, from 0 to the most, numbers without a text included."""
    counted = paths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_texts"))
    dense = counted.agg(F.max("n_tokens").alias("m")).where(F.col("m").isNotNull()).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m").cast("long"))).alias("n_tokens"))
    return dense.join(counted, "n_tokens", "left").select("n_tokens", F.coalesce("n_texts", F.lit(0)).alias("n_texts"))


def cheapest_paths(costs: dict[int, int], edges: list[tuple[int, int, int]], start: int, end: int, keep: int) -> list[tuple[int, list[int]]]:
    """The ``keep`` cheapest paths of an acyclic graph as (cost, nodes), equal costs in the order of their nodes."""
    if start not in costs:
        return []
    after: dict[int, list[tuple[int, int]]] = {}
    for src, dst, cost in edges:
        if dst in costs:
            after.setdefault(src, []).append((dst, cost + costs[dst]))
    order, seen, stack = [], {start: 1}, [(start, iter(after.get(start, ())))]
    while stack:
        node, rest = stack[-1]
        for dst, _ in rest:
            if seen.get(dst) == 1:
                raise ValueError("the graph has a cycle")
            if dst not in seen:
                seen[dst] = 1
                stack.append((dst, iter(after.get(dst, ()))))
                break
        else:
            seen[node] = 2
            order.append(node)
            stack.pop()
    best: dict[int, list[tuple[int, list[int]]]] = {start: [(costs[start], [start])]}
    for node in reversed(order):
        paths = best[node] = sorted(best.get(node, []))[:keep]
        if node == end:
            continue
        for dst, step in after.get(node, ()):
            best.setdefault(dst, []).extend((cost + step, [*path, dst]) for cost, path in paths)
    return sorted(best.get(end, []))[:keep]


def k_shortest(node_costs: DataFrame, edges: DataFrame, start: int, end: int, k: int = 5, threshold: int | None = None, beam: int | None = None, backward: bool = False) -> DataFrame:
    """The k cheapest paths of a graph given as (graph_id, node, cost) and (graph_id, src, dst, cost).

    The rows of each graph meet once and are searched together; at each node only the k
    cheapest partial paths are kept (``beam`` keeps fewer). If a graph has more than MOST_EDGES
    edges, all are grown by joins instead. ``threshold`` drops paths that cost more than the
    best plus it. ``backward`` grows from the end along reversed edges; the paths are the same.
    Graphs must be acyclic; a path is an array of nodes.
    """
    if backward:
        grown = k_shortest(node_costs, edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "cost"), end, start, k, threshold, beam)
        return grown.withColumn("path", F.reverse("path"))
    keep = min(k, beam) if beam else k
    largest = edges.groupBy("graph_id").count().agg(F.max("count")).first()[0] or 0
    done = _searched(node_costs, edges, start, end, keep) if largest <= MOST_EDGES else _grown(node_costs, edges, start, end, keep)
    ranked = done.withColumn("rank_no", F.row_number().over(Window.partitionBy("graph_id").orderBy("cost", "path"))).where(F.col("rank_no") <= k)
    if threshold is not None:
        ranked = ranked.withColumn("_best", F.min("cost").over(Window.partitionBy("graph_id"))).where(F.col("cost") <= F.col("_best") + threshold).drop("_best")
    return ranked.select("graph_id", "rank_no", "path", "cost")


def _searched(node_costs: DataFrame, edges: DataFrame, start: int, end: int, keep: int) -> DataFrame:
    key = node_costs.schema["graph_id"].dataType.simpleString()
    number = lambda c: F.col(c).cast("long").alias(c)
    nodes = node_costs.select("graph_id", F.lit(None).cast("long").alias("src"), F.col("node").cast("long").alias("dst"), number("cost"))
    rows = nodes.unionByName(edges.select("graph_id", number("src"), number("dst"), number("cost")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, costs, steps = None, {}, []

        def solved() -> pa.RecordBatch:
            paths = cheapest_paths(costs, steps, start, end, keep)
            columns = [pa.array([now] * len(paths), kind), pa.array([p for _, p in paths], pa.list_(pa.int64())), pa.array([c for c, _ in paths], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["graph_id", "path", "cost"])

        for batch in batches:
            kind = batch.column(0).type
            for graph, src, dst, cost in zip(*(c.to_pylist() for c in batch.columns)):
                if graph != now:
                    if costs:
                        yield solved()
                    now, costs, steps = graph, {}, []
                if src is None:
                    costs[dst] = cost
                else:
                    steps.append((src, dst, cost))
        if costs:
            yield solved()

    together = rows.where(F.col("graph_id").isNotNull()).repartition("graph_id").sortWithinPartitions("graph_id")
    return together.mapInArrow(run, f"graph_id {key}, path array<long>, cost long")


def _grown(node_costs: DataFrame, edges: DataFrame, start: int, end: int, keep: int) -> DataFrame:
    """The same grown breadth-first over the edge table, one join per length."""
    steps = edges.join(node_costs.select("graph_id", F.col("node").alias("dst"), F.col("cost").alias("_n")), ["graph_id", "dst"]).select("graph_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), (F.col("cost") + F.col("_n")).alias("_step"))
    frontier = node_costs.where(F.col("node") == start).select("graph_id", F.array(F.col("node").cast("long")).alias("path"), F.col("cost").cast("long").alias("cost"))
    done = frontier.where(F.lit(start == end))
    longest = node_costs.groupBy("graph_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(longest) - 1):
        tail = frontier.withColumn("src", F.element_at("path", -1))
        grown = tail.join(steps, ["graph_id", "src"]).select("graph_id", F.concat("path", F.array("dst")).alias("path"), (F.col("cost") + F.col("_step")).alias("cost"), F.col("dst").alias("_at"))
        order = Window.partitionBy("graph_id", "_at").orderBy("cost", "path")
        grown = grown.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep).select("graph_id", "path", "cost", "_at")
        grown = durable(grown)
        if grown.isEmpty():
            break
        done = done.unionByName(grown.where(F.col("_at") == end).drop("_at"))
        frontier = grown.where(F.col("_at") != end).drop("_at")
    return done


def path_diversity(paths: DataFrame) -> DataFrame:
    """Per graph: distinct nodes and edges of its paths, and their mean pairwise Jaccard distance.

    The paths of a graph meet once, in one row; nothing is joined. Paths that are NULL don't count.
    Rows without a graph get no edges and no distance.
    """
    either = lambda x, y: F.size(F.array_union(x["p"], y["p"]))
    distance = lambda x, y: F.when(either(x, y) > 0, 1 - F.size(F.array_intersect(x["p"], y["p"])) / either(x, y)).otherwise(0.0)
    add = lambda a, x, y: F.when(y["rank_no"] > x["rank_no"], F.struct((a["s"] + distance(x, y)).alias("s"), (a["n"] + 1).alias("n"))).otherwise(a)
    none = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"))
    steps = lambda p: F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    distinct = lambda c: F.size(F.filter(c, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(c, i - 1)))).cast("long")

    met = paths.where(F.col("path").isNotNull()).groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("rank_no", F.col("path").alias("p")))).alias("ps"))
    met = met.where(F.exists("ps", lambda x: F.size(x["p"]) > 0)).select(
        "graph_id", F.sort_array(F.array_compact(F.flatten("ps.p"))).alias("nodes"), F.sort_array(F.flatten(F.transform("ps.p", steps))).alias("edges"),
        F.aggregate("ps", none, lambda a, x: F.aggregate("ps", a, lambda b, y: add(b, x, y))).alias("d"),
    )
    named = F.col("graph_id").isNotNull()
    return met.select("graph_id", distinct("nodes").alias("n_nodes"), F.when(named, distinct("edges")).otherwise(0).alias("n_edges"), F.when(named & (F.col("d.n") > 0), F.col("d.s") / F.col("d.n")).otherwise(0.0).alias("mean_distance"))


def add_costs(costs: Column, addition: int) -> Column:
    """A 32-bit cost array plus a number, saturating."""
    return F.transform(costs, lambda c: F.greatest(F.lit(-2147483648), F.least(F.lit(2147483647), c.cast("long") + addition)).cast("int"))


def best_predecessor(costs: Column, connections: Column) -> Column:
    """Struct of the first index and value of the least sum of two arrays; NULL if they are empty."""
    sums = F.zip_with(costs, connections, lambda a, b: a.cast("long") + b)
    return F.when(F.size(costs) > 0, F.struct((F.array_position(sums, F.array_min(sums)) - 1).cast("int").alias("ix"), F.array_min(sums).alias("cost")))

"""Word lattices as tables: nodes, edges, and their statistics.

A lexicon that fits into a task is searched along each text. For a larger one the
common-prefix search is an equi-join: every substring that is no longer than the longest
surface is a candidate key. Positions at
which no entry starts get nodes from the unknown-word templates of their category, runs of
one category found as islands.

Nodes carry start_pos and end_pos in characters; ``node_ix`` orders the nodes that end at
one position as the solvers see them (earlier start first, run-time words before system
words, shorter before longer, then by word id), which decides ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsumugi.operators.lexicon import NO_CONNECTION, UNKNOWN_COST, Lexicon
from tsumugi.operators.solver import MOST_ENTRIES, Words
from tsumugi.runtime import spread

NODE = ["text_id", "start_pos", "end_pos", "surface", "layer", "word_id", "left_id", "right_id", "pos_id", "wcost", "feature", "is_unknown"]


def positions(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """text_id, start_pos, one character and its category for every position."""
    spots = texts.select("text_id", "text", F.explode(F.sequence(F.lit(0), F.char_length("text") - 1)).alias("start_pos")).where(F.char_length("text") > 0)
    return lexicon.with_category(spots.withColumn("c", F.expr("substring(text, start_pos + 1, 1)")))


def dictionary_nodes(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Nodes of entries that start at each position, by a join with all substrings. Their estimated size is that of the texts,
    far too low, so they must not be the side that is broadcast."""
    longest = lexicon.entries.agg(F.max(F.char_length("surface"))).first()[0] or 0
    spans = texts.where(F.char_length("text") > 0).select("text_id", "text", F.explode(F.sequence(F.lit(0), F.char_length("text") - 1)).alias("start_pos"))
    spans = spans.select("text_id", "text", "start_pos", F.explode(F.sequence(F.lit(1), F.least(F.lit(max(longest, 1)), F.char_length("text") - F.col("start_pos")))).alias("n"))
    keys = spans.select("text_id", "start_pos", (F.col("start_pos") + F.col("n")).alias("end_pos"), F.expr("substring(text, start_pos + 1, n)").alias("surface"))
    return keys.hint("merge").join(lexicon.entries, "surface").withColumn("is_unknown", F.lit(False)).select(*NODE)


def entries_found(texts: DataFrame, lexicon: Lexicon, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """surface, layer and wcost of entries that start anywhere in (text_id, text), and n, how often; several rows of one entry add up.

    A lexicon that fits into a task is counted along the texts there, so what leaves a task is no larger than the lexicon.
    """
    words = Words.fitting(lexicon, most_entries)
    if words is None:
        return dictionary_nodes(texts, lexicon).groupBy("surface", "layer", "wcost").agg(F.count(F.lit(1)).alias("n"))
    rows = texts.select("text").where(F.col("text").isNotNull() & (F.col("text") != ""))
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value.prepare()
        counts = np.zeros(words.known, np.int64)
        for batch in batches:
            for same in pc.value_counts(batch.column(0)).to_pylist():
                for found in words.nodes(same["values"]):
                    for _, node in found:
                        if node < words.known:
                            counts[node] += same["counts"]
        at = np.flatnonzero(counts)
        members = words.table.select(["surface", "layer", "wcost"]).take(pa.array(at)).combine_chunks()
        yield from members.append_column("n", pa.array(counts[at])).to_batches()

    return spread(rows).mapInArrow(run, "surface string, layer int, wcost int, n long")


def unknown_nodes(texts: DataFrame, lexicon: Lexicon, known: DataFrame) -> DataFrame:
    """Nodes for positions without an entry: one character per template, and grouped runs of 2 or more."""
    spots = positions(texts.select("text_id", "text"), lexicon)
    grouping = sorted(lexicon.categories().grouping)
    by_text = Window.partitionBy("text_id").orderBy("start_pos")
    island = F.sum(F.when(F.lag("category").over(by_text) == F.col("category"), 0).otherwise(1)).over(by_text)
    spots = spots.withColumn("island", island)
    spots = spots.withColumn("run", F.max("start_pos").over(Window.partitionBy("text_id", "island")) - F.col("start_pos") + 1)
    bare = spots.join(known.select("text_id", "start_pos").distinct().hint("merge"), ["text_id", "start_pos"], "left_anti")
    lengths = F.when(F.col("category").isin(*grouping) & (F.col("run") > 1), F.sequence(F.lit(1), F.col("run"))).otherwise(F.array(F.lit(1)))
    spans = bare.select("text_id", "text", "start_pos", "category", F.explode(lengths).alias("n"))
    nodes = spans.join(lexicon.unknown.withColumn("_there", F.lit(True)), "category", "left").where((F.col("n") == 1) | F.coalesce(F.col("entry_ix") == 0, F.lit(True)))
    member = lambda name, default: F.when(F.col("_there"), F.col(name)).otherwise(default).alias(name)
    return nodes.select(
        "text_id", "start_pos", (F.col("start_pos") + F.col("n")).alias("end_pos"), F.expr("substring(text, start_pos + 1, n)").alias("surface"), F.lit(1).alias("layer"), F.lit(None).cast("long").alias("word_id"),
        member("left_id", F.lit(0)), member("right_id", F.lit(0)), member("pos_id", F.lit(0)), member("wcost", F.lit(UNKNOWN_COST)), member("feature", F.concat(F.lit("未知語,"), F.col("category"))), F.lit(True).alias("is_unknown"), F.coalesce("entry_ix", F.lit(0)).alias("_template"),
    )


def joined_nodes(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """All nodes of (text_id, text) by joins, for a lexicon of any size."""
    known = dictionary_nodes(texts, lexicon)
    nodes = known.withColumn("_template", F.lit(0)).unionByName(unknown_nodes(texts, lexicon, known))
    order = Window.partitionBy("text_id", "end_pos").orderBy("start_pos", "layer", "is_unknown", "_template", F.coalesce("word_id", F.lit(-1)), "wcost", "left_id", "feature")
    return nodes.withColumn("node_ix", F.row_number().over(order) - 1).drop("_template")


def lattice_nodes(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """All nodes of (text_id, text), with node_ix among the nodes that end at one position.

    Texts are read where they lie if the lexicon fits into a task, and joined with it else.
    """
    words = Words.fitting(lexicon)
    if words is None:
        return joined_nodes(texts, lexicon)
    rows = texts.select("text_id", "text").where(F.col("text").isNotNull() & (F.col("text") != ""))
    shared = texts.sparkSession.sparkContext.broadcast(words)
    key = rows.schema.fields[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value.prepare()
        for batch in batches:
            whose, starts, ends, places, nodes, surfaces = ([] for _ in range(6))
            for n, text in enumerate(batch.column(1).to_pylist()):
                for end, found in enumerate(words.nodes(text)):
                    whose += [n] * len(found)
                    ends += [end] * len(found)
                    places += range(len(found))
                    for start, node in found:
                        starts.append(start)
                        nodes.append(node)
                        surfaces.append(text[start:end])
            members = words.members().select(["layer", "word_id", "left_id", "right_id", "pos_id", "wcost", "feature"]).take(pa.array(nodes, pa.int64())).combine_chunks()
            unknown = pa.array(np.array(nodes, np.int64) >= words.known)
            number = lambda c: pa.array(c, pa.int32())
            columns = [batch.column(0).take(pa.array(whose, pa.int64())), number(starts), number(ends), pa.array(surfaces, pa.string()), *(members.column(i).combine_chunks() for i in range(7)), unknown, number(places)]
            yield pa.RecordBatch.from_arrays(columns, names=[*NODE, "node_ix"])

    schema = f"text_id {key}, start_pos int, end_pos int, surface string, layer int, word_id long, left_id int, right_id int, pos_id int, wcost int, feature string, is_unknown boolean, node_ix int"
    return spread(rows).mapInArrow(run, schema)


ENTRIES = "text_id long, end_pos int, node_ix int, surface string, cumulative_cost long, connection_cost int, prev_end int, prev_ix int, on_best_path boolean"


def search_entries(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """What the search keeps of every node that a path reaches: the cost up to it, its best
    predecessor (prev_ix -1 at 0 is the begin) and whether it is on the best path, with
    ``cost_delta``: for nodes on the best path, how much dearer the best other node is that ends
    at the same position. The lexicon must fit into a task.
    """
    words = Words.fitting(lexicon)
    if words is None:
        raise ValueError("the lexicon is too large to be held by every task")
    rows = texts.select(F.col("text_id").cast("long").alias("text_id"), "text").where(F.col("text").isNotNull() & (F.col("text") != ""))
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value.prepare()
        for batch in batches:
            out = [(i, e, p, t[s:e], cost, c, s, at, best) for i, t in zip(*(c.to_pylist() for c in batch.columns)) for e, p, _, cost, c, s, at, best in words.entries(t)]
            columns = list(zip(*out)) if out else [[]] * 9
            types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in ENTRIES.split(", ")])

    entries = spread(rows).mapInArrow(run, ENTRIES)
    at = Window.partitionBy("text_id", "end_pos")
    other = F.min(F.when(~F.col("on_best_path"), F.col("cumulative_cost"))).over(at)
    return entries.withColumn("cost_delta", F.when(F.col("on_best_path"), other - F.col("cumulative_cost")))


EDGES = "from_end int, from_ix int, to_end int, to_ix int, ccost int, wcost int, on_best_path boolean"
MOST_ROWS = 1 << 17  # from which on edges are handed on within a batch of texts


def text_edges(texts: DataFrame, words: Words) -> DataFrame:
    """Edges of (text_id, text) as ``lattice_edges`` gives them, and whether they are on the best path, read along each text without a join.

    Texts that are equal are searched once per batch. NULL ids and texts have no edges.
    """
    rows = texts.select("text_id", "text").where(F.col("text_id").isNotNull() & F.col("text").isNotNull())
    shared = texts.sparkSession.sparkContext.broadcast(words)
    key = rows.schema.fields[0].dataType.simpleString()
    names = ["text_id", *(c.split()[0] for c in EDGES.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value.prepare()

        def edges(ids: pa.Array, found: list[np.ndarray]) -> pa.RecordBatch:
            whose = np.repeat(np.arange(len(found)), [len(x) for x in found])
            columns = np.concatenate(found).T
            return pa.RecordBatch.from_arrays([ids.take(pa.array(whose)), *(pa.array(c.astype(np.int32)) for c in columns[:-1]), pa.array(columns[-1].astype(bool))], names=names)

        for batch in batches:
            seen: dict[str, np.ndarray] = {}
            found, first, size = [], 0, 0
            for n, text in enumerate(batch.column(1).to_pylist(), 1):
                if text not in seen:
                    seen[text] = np.array(words.edges(text), np.int64)
                found.append(seen[text])
                size += len(seen[text])
                if size >= MOST_ROWS or n == len(batch):
                    yield edges(batch.column(0).slice(first, n - first), found)
                    found, first, size = [], n, 0

    return spread(rows).mapInArrow(run, f"text_id {key}, {EDGES}")


def all_edges(texts: DataFrame, lexicon: Lexicon, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """All edges of (text_id, text): read along the texts if the lexicon fits into a task, joined else."""
    words = Words.fitting(lexicon, most_entries)
    return lattice_edges(joined_nodes(texts, lexicon), texts, lexicon) if words is None else text_edges(texts, words).drop("on_best_path")


def lattice_edges(nodes: DataFrame, texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Edges between nodes that meet, from the begin (node_ix -1 at 0) and to the end of each text, with costs.

    Estimated sizes of nodes are those of their texts, far too low, so the side to broadcast is not left to Catalyst here.
    """
    ends = texts.select("text_id", F.char_length("text").alias("n"))
    head = ends.select("text_id", F.lit(0).alias("from_end"), F.lit(-1).alias("from_ix"), F.lit(0).alias("right_id"))
    left = nodes.select("text_id", F.col("end_pos").alias("from_end"), F.col("node_ix").alias("from_ix"), "right_id").unionByName(head)
    tail = ends.select("text_id", F.col("n").alias("start_pos"), (F.col("n") + 1).alias("to_end"), F.lit(-1).alias("to_ix"), F.lit(0).alias("left_id"), F.lit(0).alias("wcost"))
    right = nodes.select("text_id", "start_pos", F.col("end_pos").alias("to_end"), F.col("node_ix").alias("to_ix"), "left_id", "wcost").unionByName(tail)
    meet = left.hint("merge").join(right, (left.text_id == right.text_id) & (left.from_end == right.start_pos)).drop(right.text_id)
    cells = lexicon.connections.select("right_id", "left_id", F.col("cost").alias("ccost"))
    return meet.join(cells, ["right_id", "left_id"], "left").select("text_id", "from_end", "from_ix", "to_end", "to_ix", F.coalesce("ccost", F.lit(NO_CONNECTION)).alias("ccost"), "wcost")


def lattice_stats(nodes: DataFrame) -> DataFrame:
    """Per text: nodes, positions, most and mean nodes at a position, and the saturating product of the counts."""
    at = nodes.groupBy("text_id", "end_pos").agg(F.count(F.lit(1)).alias("n"))
    most = F.lit("18446744073709551615").cast("decimal(20,0)")
    bits = F.sum(F.log2("n"))
    exact = F.aggregate(F.collect_list(F.col("n").cast("decimal(20,0)")), F.lit(1).cast("decimal(38,0)"), lambda a, n: (a * n).cast("decimal(38,0)"))
    return at.groupBy("text_id").agg(
        F.sum("n").alias("n_nodes"), F.count(F.lit(1)).alias("n_positions"), F.max("n").alias("most_nodes"), F.avg("n").alias("mean_nodes"),
        F.when(bits < 62, exact).otherwise(most).cast("decimal(20,0)").alias("estimated_paths"),
    )


def connection_stats(connections: DataFrame) -> DataFrame:
    """Least, greatest and mean cost, zero cells and their share (NULL over nothing)."""
    zeros = F.count_if(F.col("cost") == 0)
    return connections.agg(F.min("cost").alias("min_cost"), F.max("cost").alias("max_cost"), F.avg("cost").alias("avg_cost"), zeros.alias("n_zero"), (zeros / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("sparsity"))

"""Best and k best segmentations.

The solver reads one text after the other in Arrow batches with the lexicon held as a
prefix map in every task, so no text is shuffled. It walks a text once, pushing what can
still win from each position: of the nodes that end at a position only the k cheapest of
each right id, and of the grouped unknown words of a run only the k cheapest starts, so it is
linear in the text's length. The lexicon reaches the tasks only if it has at most
MOST_ENTRIES rows and MOST_BYTES of text; a larger one is joined relationally (joined_nodes)
and a solver runs on the joined nodes. Connection costs go as a matrix over the ids that
occur, which may have MOST_CELLS cells.

Ties go to the predecessor that comes first among the nodes ending at a position. Only the
end node ends a path. k best paths are exact. ``compat_eos`` reproduces solvers that let the
cheapest final entry of any kind end the path.

Defined results: NULL and empty texts have no token; every character is covered, so the
surfaces of a path always give back the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsumugi.operators.lattice import joined_nodes
from tsumugi.operators.lexicon import Lexicon
from tsumugi.operators.solver import MOST_ENTRIES, Matrix, Words
from tsumugi.runtime import spread

TOKENS = "text_id long, path_no int, path_cost long, token_ix int, surface string, start_pos int, end_pos int, word_id long, pos_id int, left_id int, right_id int, wcost int, ccost int, feature string, is_unknown boolean"
TOKEN_SCHEMA = pa.schema(
    [("text_id", pa.int64()), ("path_no", pa.int32()), ("path_cost", pa.int64()), ("token_ix", pa.int32()), ("surface", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("word_id", pa.int64())]
    + [("pos_id", pa.int32()), ("left_id", pa.int32()), ("right_id", pa.int32()), ("wcost", pa.int32()), ("ccost", pa.int32()), ("feature", pa.string()), ("is_unknown", pa.bool_())]
)

# A node: (start, end, word_id, left_id, right_id, pos_id, wcost, feature, is_unknown)
Node = tuple


def solve(ending: list[list[Node]], connection: Callable[[int, int], int], k: int = 1, compat_eos: bool = False) -> list[tuple[int, list[tuple[Node, int]]]]:
    """The k cheapest paths as (cost, [(node, connection cost to it), ...])."""
    if k == 1:
        return [_best(ending, connection, compat_eos)]
    n = len(ending) - 1
    # By end position: per node its partial paths (cost, predecessor's partial, node, connection cost), cheapest first.
    begin = (0, None, None, 0)
    partial: list[list[tuple[int, list[tuple]]]] = [[(0, [begin])]] + [[] for _ in range(n)]

    def extend(node: Node, left_id: int, wcost: int, start: int) -> list[tuple]:
        options = []
        for right_id, paths in partial[start]:
            c = connection(right_id, left_id)
            options.extend((p[0] + c + wcost, p, node, c) for p in paths)
        options.sort(key=lambda o: o[0])
        return options[:k]

    for end in range(1, n + 1):
        for node in ending[end]:
            if partial[node[0]]:
                partial[end].append((node[4], extend(node, node[3], node[6], node[0])))
    final = extend(None, 0, 0, n)
    return [(cost, _trace(p)) for cost, p, _, _ in final]


def _trace(p: tuple | None) -> list[tuple[Node, int]]:
    path = []
    while p is not None and p[2] is not None:
        path.append((p[2], p[3]))
        p = p[1]
    return path[::-1]


def _best(ending: list[list[Node]], connection: Callable[[int, int], int], compat_eos: bool) -> tuple[int, list[tuple[Node, int]]]:
    """The cheapest path. Of the nodes that end at one position with one right id only the cheapest
    can go on, and nodes with one left id that start at one position share their predecessor."""
    n = len(ending) - 1
    at: list[list[tuple]] = [[(0, None, None, 0, 0)]] + [[] for _ in range(n)]  # (cost, predecessor, node, connection cost, right id)
    shared: list[dict[int, tuple]] = [{} for _ in range(n + 1)]

    def predecessor(start: int, left_id: int) -> tuple:
        hit = shared[start].get(left_id)
        if hit is None:
            best = None
            for p in at[start]:
                c = connection(p[4], left_id)
                if best is None or p[0] + c < best[0]:
                    best = (p[0] + c, p, c)
            hit = shared[start][left_id] = best
        return hit

    for end in range(1, n + 1):
        kept: dict[int, tuple] = {}
        for i, node in enumerate(ending[end]):
            if at[node[0]]:
                cost, p, c = predecessor(node[0], node[3])
                cost += node[6]
                old = kept.get(node[4])
                if old is None or cost < old[1]:
                    kept[node[4]] = (i, cost, p, node, c)
        at[end] = [(cost, p, node, c, node[4]) for _, cost, p, node, c in sorted(kept.values(), key=lambda x: x[0])]
    cost, last, _ = predecessor(n, 0)
    if compat_eos and n:
        word = min(at[n], key=lambda x: x[0])
        if word[0] <= cost:
            return word[0], _trace(word[1])
    return cost, _trace(last)


def _tokens(rows: Iterator[tuple[int, str, list[list[Node]]]], connection: Callable[[int, int], int], k: int, compat_eos: bool) -> pa.RecordBatch:
    out = []
    for text_id, text, ending in rows:
        for number, (cost, path) in enumerate(solve(ending, connection, k, compat_eos), 1):
            for ix, ((a, b, word, left, right, pos, wcost, feature, unknown), c) in enumerate(path):
                out.append((text_id, number, cost, ix, text[a:b], a, b, word, pos, left, right, wcost, c, feature, unknown))
    columns = list(zip(*out)) if out else [[]] * len(TOKEN_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, TOKEN_SCHEMA)], schema=TOKEN_SCHEMA)


def _solved(ids: list[int], texts: list[str], words: Words, k: int, compat_eos: bool) -> pa.RecordBatch:
    """Tokens of texts; members of the nodes are taken from the table."""
    whose, numbers, costs, places, starts, ends, nodes, connections, surfaces = ([] for _ in range(9))
    for text_id, text in zip(ids, texts):
        paths = [words.best(text, compat_eos)] if k == 1 else words.k_best(text, k)
        for number, (cost, path) in enumerate(paths, 1):
            whose += [text_id] * len(path)
            numbers += [number] * len(path)
            costs += [cost] * len(path)
            places += range(len(path))
            for a, b, node, c in path:
                starts.append(a)
                ends.append(b)
                nodes.append(node)
                connections.append(c)
                surfaces.append(text[a:b])
    members = words.members()
    at = pa.array(nodes, pa.int64())
    of = lambda name: members.column(name).take(at).combine_chunks()
    unknown = pa.array(np.array(nodes, np.int64) >= words.known)
    columns = [whose, numbers, costs, places, surfaces, starts, ends, of("word_id"), of("pos_id"), of("left_id"), of("right_id"), of("wcost"), connections, of("feature"), unknown]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(columns, TOKEN_SCHEMA)], schema=TOKEN_SCHEMA)


def tokenize(texts: DataFrame, lexicon: Lexicon, k: int = 1, compat_eos: bool = False, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """Tokens of the k best paths of every (text_id, text)."""
    rows = texts.select(F.col("text_id").cast("long").alias("text_id"), "text").where(F.col("text").isNotNull() & (F.col("text") != ""))
    words = Words.fitting(lexicon, most_entries)
    if words is None:
        return _tokenize_joined(rows, lexicon, k, compat_eos)
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value.prepare()
        for batch in batches:
            yield _solved(batch.column(0).to_pylist(), batch.column(1).to_pylist(), words, k, compat_eos)

    return spread(rows).mapInArrow(run, TOKENS)


def _tokenize_joined(texts: DataFrame, lexicon: Lexicon, k: int, compat_eos: bool) -> DataFrame:
    """The same over nodes joined to the texts, for lexicons too large to hand to every task."""
    members = ["start_pos", "end_pos", "layer", "word_id", "left_id", "right_id", "pos_id", "wcost", "feature", "is_unknown"]
    nodes = joined_nodes(texts, lexicon).groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("end_pos", "node_ix", *[m for m in members if m != "end_pos"]))).alias("nodes"))
    shared = texts.sparkSession.sparkContext.broadcast(Matrix.of(lexicon.connections))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = shared.value.cost
        for batch in batches:
            rows = []
            for i, t, found in zip(*(c.to_pylist() for c in batch.columns)):
                ending: list[list[Node]] = [[] for _ in range(len(t) + 1)]
                for x in found:
                    ending[x["end_pos"]].append((x["start_pos"], x["end_pos"], x["word_id"], x["left_id"], x["right_id"], x["pos_id"], x["wcost"], x["feature"], x["is_unknown"]))
                rows.append((i, t, ending))
            yield _tokens(iter(rows), cost, k, compat_eos)

    return texts.join(nodes, "text_id").select("text_id", "text", "nodes").mapInArrow(run, TOKENS)


def wakati(tokens: DataFrame, of: str = "surface") -> DataFrame:
    """Surfaces (or word ids) of each best path, joined by blanks."""
    first = tokens.where(F.col("path_no") == 1)
    ordered = F.array_sort(F.collect_list(F.struct("token_ix", F.coalesce(F.col(of).cast("string"), F.lit("")).alias("v"))))
    return first.groupBy("text_id").agg(ordered.alias("t")).select("text_id", F.array_join(F.transform("t", lambda x: x["v"]), " ").alias("wakati"))

"""Word vectors: lookup, pooling, similarity, vocabulary and training."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsumugi.runtime import numbered

UNKNOWN_WORD = 4294967295  # fixed value
STEP = 256  # pairs per update
REPEATS = 4  # gradients of one word that an update adds up in full
MOST_BYTES = 1 << 30  # of the two layers that a training task holds
ROWS = 1024  # words of a layer that are averaged together
QUERIES = 4096  # vectors compared with all others in one pass


def lookup(tokens: DataFrame, vectors: DataFrame) -> DataFrame:
    """Tokens with the embedding of their word id, NULL for unknown words."""
    return tokens.join(vectors.select("word_id", "embedding"), (tokens.word_id == vectors.word_id) & (tokens.word_id != UNKNOWN_WORD), "left").drop(vectors.word_id)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; NULL for unequal lengths or a norm product below 1e-10."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm >= 1e-10), dot(a, b) / norm)


def mean_pooling(rows: DataFrame, key: str) -> DataFrame:
    """Element-wise mean of (key, embedding): one sum per dimension, partial before the shuffle."""
    parts = rows.where(F.col("embedding").isNotNull()).select(key, F.posexplode("embedding").alias("i", "v"))
    means = parts.groupBy(key, "i").agg(F.avg("v").alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m")))
    return means.groupBy(key).agg(F.transform(ordered, lambda x: x["m"]).alias("embedding"))


def vocabulary(lists: DataFrame, min_count: int, sample: float) -> DataFrame:
    """word_id, n, remapped_id by descending count (then word id) and keep probability."""
    words = lists.select(F.explode("word_ids").alias("word_id")).where(F.col("word_id").isNotNull()).groupBy("word_id").agg(F.count(F.lit(1)).alias("n"))
    total = words.agg(F.sum("n").alias("t")).scalar()
    ranked = numbered(words.where(F.col("n") >= min_count), [F.desc("n"), F.col("word_id")], "remapped_id")
    frequency = F.col("n") / total
    keep = F.when(F.lit(sample) <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.sqrt(F.lit(sample) / frequency) + F.lit(sample) / frequency))
    return ranked.select("word_id", "n", "remapped_id", keep.alias("sample_prob"))


def context_pairs(lists: DataFrame, window: int) -> DataFrame:
    """(center, context) pairs of words at most ``window`` places apart, within each list."""
    at = lambda i: F.element_at("word_ids", i)
    near = lambda i: F.filter(F.sequence(F.greatest(F.lit(1), i - window), F.least(F.size("word_ids"), i + window)), lambda j: j != i)
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("word_ids")), lambda i: F.transform(near(i), lambda j: F.struct(at(i).alias("center"), at(j).alias("context")))))
    return lists.where(F.size("word_ids") > 1).select(F.explode(pairs).alias("p")).select("p.center", "p.context")


def _sentence_pairs(sentence: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centers, contexts) of a sentence whose words look ``spans`` places to both sides."""
    centers, contexts = [sentence[:0]], [sentence[:0]]
    for o in range(1, int(spans.max(initial=0)) + 1):
        i = np.flatnonzero(spans >= o)
        for j in (i - o, i + o):
            inside = (j >= 0) & (j < len(sentence))
            centers.append(sentence[i[inside]])
            contexts.append(sentence[j[inside]])
    return np.concatenate(centers), np.concatenate(contexts)


def _step(a: np.ndarray, b: np.ndarray, touched: np.ndarray, pairs: list, table: np.ndarray, negative: int, rate: float, draw: np.random.Generator) -> None:
    """One update of both layers from a few hundred pairs with drawn negatives."""
    center, context = (np.concatenate(x) for x in zip(*pairs))
    if not len(center):
        return
    noise = np.minimum(np.searchsorted(table, draw.random((len(center), negative))), len(a) - 1)
    targets = np.concatenate((center[:, None], noise), axis=1)
    label = (targets == center[:, None]).astype(np.float32)
    h, out = a[context], b[targets]
    score = np.einsum("pkd,pd->pk", out, h)
    g = ((label - 1 / (1 + np.exp(-np.clip(score, -6, 6)))) * rate).astype(np.float32)
    for matrix, layer, rows, change in ((a, 0, context, np.einsum("pk,pkd->pd", g, out)), (b, 1, targets.ravel(), (g[:, :, None] * h[:, None, :]).reshape(-1, a.shape[1]))):
        order = np.argsort(rows, kind="stable")
        ids, first, n = np.unique(rows[order], return_index=True, return_counts=True)
        # All gradients of a step start from the same vectors: of a word's n only the sum of REPEATS mean ones is taken.
        matrix[ids] += np.add.reduceat(change[order], first, axis=0) * np.minimum(1.0, REPEATS / n).astype(np.float32)[:, None]
        touched[ids, layer] += n


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean change of the words of each block, weighted by how often they were touched; parts come sorted by block."""
    now, sums, n = None, None, None

    def done() -> pa.RecordBatch:
        mean = (sums / np.maximum(n, 1)[:, None]).astype(np.float32)
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([mean.tobytes()], pa.binary())], names=["layer", "block", "mean"])

    for batch in batches:
        for layer, block, counts, deltas in zip(*(c.to_pylist() for c in batch.columns)):
            if now is not None and (layer, block) != now:
                yield done()
                now = None
            counted = np.frombuffer(counts, np.int64)
            delta = np.frombuffer(deltas, np.float32).reshape(len(counted), -1)
            if now is None:
                now, sums, n = (layer, block), np.zeros(delta.shape), np.zeros(len(counted), np.int64)
            sums += delta * counted[:, None]
            n += counted
    if now is not None:
        yield done()


def train_word2vec(lists: DataFrame, size: int = 100, window: int = 5, negative: int = 5, min_count: int = 10, sample: float = 1e-4, alpha: float = 0.025, min_alpha: float = 0.0001, epochs: int = 3, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """word_id and embedding by skip-gram with negative sampling, averaged over partitions each epoch.

    Every partition trains on its own sentences from the shared vectors; the vectors are then
    averaged, in blocks of ROWS words, weighted by the pairs that touched each word. Both layers
    of the vocabulary (after min_count) must fit into MOST_BYTES, which is checked first: the
    tasks and the driver hold one copy each.
    """
    spark = lists.sparkSession
    ranked = vocabulary(lists, min_count, sample)
    if (words := ranked.count()) * size * 8 > MOST_BYTES:
        raise ValueError(f"{words} words of {size} dimensions exceed {MOST_BYTES} bytes; raise min_count or lower size")
    vocab = [(r.word_id, r.remapped_id, r.n, r.sample_prob) for r in ranked.orderBy("remapped_id").collect()]
    if not vocab:
        raise ValueError("the vocabulary is empty")
    ids = {w: i for w, i, _, _ in vocab}
    keep = np.array([p for *_, p in vocab])
    noise = np.cumsum(np.array([n for _, _, n, _ in vocab], float) ** 0.75)
    noise /= noise[-1]
    rng = np.random.default_rng(seed)
    syn0 = ((rng.random((len(vocab), size)) - 0.5) / size).astype(np.float32)
    syn1 = np.zeros_like(syn0)
    base = lists.select("word_ids") if partitions is None else lists.select("word_ids").repartition(partitions)
    fixed = spark.sparkContext.broadcast((ids, keep, noise))
    for epoch in range(epochs):
        rate = max(min_alpha, alpha * (1 - epoch / epochs))
        weights = spark.sparkContext.broadcast((syn0, syn1))

        def run(batches: Iterator[pa.RecordBatch], rate=rate, epoch=epoch, weights=weights) -> Iterator[pa.RecordBatch]:
            index, probability, table = fixed.value
            a, b = (w.copy() for w in weights.value)
            touched = np.zeros((len(a), 2), np.int64)
            draw = None
            waiting: list[tuple[np.ndarray, np.ndarray]] = []
            for batch in batches:
                for words in batch.column(0).to_pylist():
                    if draw is None:
                        draw = np.random.default_rng([seed, epoch, len(words or ()), (words or [0])[0] or 0])
                    sentence = np.array([index[w] for w in words or () if w in index], np.int64)
                    sentence = sentence[draw.random(len(sentence)) < probability[sentence]] if len(sentence) else sentence
                    waiting.append(_sentence_pairs(sentence, draw.integers(1, window + 1, len(sentence))))
                    if sum(len(c) for c, _ in waiting) >= min(STEP, REPEATS * len(a)):
                        _step(a, b, touched, waiting, table, negative, rate, draw)
                        waiting = []
            if waiting:
                _step(a, b, touched, waiting, table, negative, rate, draw)
            for layer, matrix, old in ((0, a, weights.value[0]), (1, b, weights.value[1])):
                for at in range(0, len(a), ROWS):
                    n = touched[at : at + ROWS, layer]
                    if n.any():
                        columns = [pa.array([layer], pa.int32()), pa.array([at // ROWS], pa.int64()), pa.array([n.tobytes()], pa.binary()), pa.array([(matrix[at : at + ROWS] - old[at : at + ROWS]).tobytes()], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names=["layer", "block", "n", "delta"])

        moved = base.mapInArrow(run, "layer int, block long, n binary, delta binary").repartition("layer", "block").sortWithinPartitions("layer", "block")
        for r in moved.mapInArrow(_mean, "layer int, block long, mean binary").toLocalIterator():
            mean = np.frombuffer(r.mean, np.float32).reshape(-1, size)
            (syn0, syn1)[r.layer][r.block * ROWS : r.block * ROWS + len(mean)] += mean
        weights.unpersist()
    return spark.createDataFrame([(w, syn0[i].tolist()) for w, i, _, _ in vocab], "word_id long, embedding array<float>")


def info(vectors: DataFrame) -> DataFrame:
    """Words, greatest word id, dimensions and zero vectors of a store (word_id, embedding)."""
    zero = F.forall("embedding", lambda v: v == 0)
    return vectors.agg(F.count(F.lit(1)).alias("n_words"), F.max("word_id").alias("max_word_id"), F.max(F.size("embedding")).alias("dim"), F.count_if(zero).alias("n_zero"))


def most_similar(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """word_id, rank_no, neighbour and cosine of the k vectors closest to each query's, itself left out.

    Queries (word_id, embedding) go to the tasks in blocks of QUERIES; each task keeps the k best
    of its vectors per query. Vectors without length or of another dimension are no neighbours;
    equal cosines are ranked by word id.
    """
    spark = vectors.sparkSession
    found, block = [], []

    def search(block: list[tuple[int, list[float]]]) -> DataFrame:
        ids, matrix = np.array([i for i, _ in block]), np.array([v for _, v in block], np.float64)
        shared = spark.sparkContext.broadcast((ids, matrix / np.maximum(np.linalg.norm(matrix, axis=1), 1e-30)[:, None]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            for batch in batches:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, matrix.shape[1])
                norm = np.linalg.norm(flat, axis=1)
                words = batch.column(0).to_numpy(zero_copy_only=False)
                scores = matrix @ (flat / np.maximum(norm, 1e-30)[:, None]).T
                scores[:, norm < 1e-15] = -np.inf
                scores[ids[:, None] == words[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(words, scores.shape), -scores), axis=1)[:, :k]
                of = np.repeat(np.arange(len(ids)), order.shape[1])
                at = order.ravel()
                kept = scores[of, at] > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(ids[of[kept]]), pa.array(words[at[kept]]), pa.array(scores[of, at][kept])], names=["word_id", "neighbour", "cosine"])

        fitting = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == matrix.shape[1])).select(F.col("word_id").cast("long").alias("word_id"), F.col("embedding").cast("array<float>").alias("embedding"))
        return fitting.mapInArrow(run, "word_id long, neighbour long, cosine double")

    for r in queries.where(F.col("embedding").isNotNull()).select("word_id", "embedding").toLocalIterator():
        block.append((r.word_id, r.embedding))
        if len(block) == QUERIES:
            found.append(search(block))
            block = []
    if block:
        found.append(search(block))
    if not found:
        return spark.createDataFrame([], "word_id long, rank_no int, neighbour long, cosine double")
    order = Window.partitionBy("word_id").orderBy(F.desc("cosine"), "neighbour")
    return reduce(DataFrame.unionByName, found).withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= k).select("word_id", "rank_no", "neighbour", "cosine")


def dense(vectors: DataFrame, max_word_id: int, dim: int) -> DataFrame:
    """Vectors for every id from 0 to ``max_word_id``, zeros where missing."""
    ids = vectors.sparkSession.range(0, max_word_id + 1).withColumnRenamed("id", "word_id")
    return ids.join(vectors, "word_id", "left").select("word_id", F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), dim)).alias("embedding"))

"""Filling containers of fixed capacity by minimum bin slack.

Items are tokens of a document; a document that exceeds the capacity is cut into pieces of
exactly the capacity and a rest, any other stays whole. What has to be solved depends only
on how many items there are of each length, at most ``capacity`` counts however many
documents there are. On these counts the planner repeatedly places the longest remaining
length and fills the rest of the container: bitset subset-sum dynamic programming over a
window of remaining lengths finds the sum closest to the capacity, the chosen multiset is
traced back, and the pattern is used as often as the counts allow.

Items take their places by rank within their length. Ranks are counted by salted groups
with running offsets, so a length shared by a third of all documents meets in no task, and
the plan's ranges are found by binary search.

Defined results: NULL or empty texts have no tokens and no row; the same plan and places
come out of every run over the same documents; settings without an id or with a capacity that is
NULL or below 1 are left out.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsumugi.runtime import durable, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WINDOW = 96  # distinct lengths that one search considers first
SALTS = 512
PACKED = "pack_id int, container_no long, doc_id long, piece_no int, start_token long, n_tokens long"

_encodings: dict[str, object] = {}


def encoding(path: str = TOKENIZER):
    """The public tokenizer whose ranks lie at ``path``, loaded once per process."""
    if path not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
        _encodings[path] = tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id and n_tokens of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    return spread(rows).mapInArrow(run, "doc_id long, n_tokens long")


def fill(counts: dict[int, int], room: int, lengths: list[int]) -> dict[int, int]:
    """Multiset of ``lengths`` (descending), within ``counts``, whose sum is closest to ``room`` from below."""
    steps: list[tuple[int, int, int]] = []
    reach = 1
    mask = (1 << (room + 1)) - 1
    full = 1 << room
    for length in lengths:
        left = min(counts[length], room // length)
        times = 1
        while left > 0:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= (reach << (length * times)) & mask
            left -= times
            times *= 2
        if reach & full:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + times
            total -= length * times
    return chosen


def plan(counts: dict[int, int], capacity: int, window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> items) and how many containers are filled by each."""
    counts = {k: n for k, n in counts.items() if n > 0}
    lengths = sorted(counts, reverse=True)
    patterns = []
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        room = capacity - longest
        fitting = [k for k in lengths if k <= room and counts[k] > 0]
        near = fitting if len(fitting) <= window else fitting[: window - window // 3] + fitting[-(window // 3) :]
        chosen = fill(counts, room, near) if room and near else {}
        if len(near) < len(fitting) and sum(k * n for k, n in chosen.items()) < room:
            wider = fill(counts, room, fitting)
            if sum(k * n for k, n in wider.items()) > sum(k * n for k, n in chosen.items()):
                chosen = wider
        counts[longest] += 1
        pattern = dict(chosen)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            counts[k] -= n * times
        patterns.append((pattern, times))
        lengths = [k for k in lengths if counts[k] > 0]
    return patterns


class Places:
    """Container of the item with a given rank within its pack and length."""

    def __init__(self, plans: list[tuple[int, dict[int, int], list[tuple[dict[int, int], int]]]]):
        self.offset: dict[tuple[int, int], int] = {}
        starts, bases, each = [], [], []
        total = 0
        for pack, counts, patterns in plans:
            ranges: dict[int, list[tuple[int, int, int]]] = {}
            container = 0
            for pattern, times in patterns:
                for length, n in pattern.items():
                    ranges.setdefault(length, []).append((container, n, times))
                container += times
            for length in counts:
                self.offset[pack, length] = total
                for base, n, times in ranges[length]:
                    starts.append(total)
                    bases.append(base)
                    each.append(n)
                    total += n * times
        self.starts, self.bases, self.each = (np.array(x, np.int64) for x in (starts, bases, each))
        keys = np.array([p << 40 | n for p, n in self.offset], np.int64)
        order = np.argsort(keys)
        self.keys, self.offsets = keys[order], np.array(list(self.offset.values()), np.int64)[order]

    def container(self, packs: np.ndarray, lengths: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Containers, from 1, of items with ranks from 0."""
        at = self.offsets[np.searchsorted(self.keys, packs.astype(np.int64) << 40 | lengths)] + ranks
        i = np.searchsorted(self.starts, at, side="right") - 1
        return self.bases[i] + (at - self.starts[i]) // self.each[i] + 1


def pack(documents: DataFrame, settings: list[tuple[int, int]], path: str = TOKENIZER, salts: int = SALTS) -> DataFrame:
    """pack_id, container_no, doc_id, piece_no, start_token and n_tokens of every item.

    ``settings`` are (pack_id, capacity). The token counts are written to the shared folder
    once; the driver sees one count per length and capacity.
    """
    settings = [(p, c) for p, c in settings if p is not None and c and c > 0]
    if not settings:
        return documents.sparkSession.createDataFrame([], PACKED)
    counted = durable(token_counts(documents, path)).where(F.col("n_tokens") > 0)
    options = F.array(*[F.struct(F.lit(p).cast("int").alias("pack_id"), F.lit(c).cast("long").alias("capacity")) for p, c in settings])
    pieces = counted.withColumn("o", F.explode(options)).select("doc_id", "n_tokens", "o.pack_id", "o.capacity")
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / F.col("capacity")).cast("long"))))
    items = pieces.select(
        "pack_id", "doc_id", (F.col("piece") + 1).cast("int").alias("piece_no"), (F.col("piece") * F.col("capacity")).alias("start_token"),
        F.least(F.col("capacity"), F.col("n_tokens") - F.col("piece") * F.col("capacity")).alias("n_tokens"),
    )
    items = items.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(salts)))

    counts = items.groupBy("pack_id", "n_tokens", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    by_length: dict[int, dict[int, int]] = {p: {} for p, _ in settings}
    for r in counts.groupBy("pack_id", "n_tokens").agg(F.sum("_n").alias("n")).orderBy("pack_id", F.desc("n_tokens")).collect():
        by_length[r.pack_id][r.n_tokens] = r.n
    places = items.sparkSession.sparkContext.broadcast(Places([(p, by_length[p], plan(by_length[p], c)) for p, c in settings]))

    before = Window.partitionBy("pack_id", "n_tokens").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("pack_id", "n_tokens", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("pack_id", "n_tokens", "_salt").orderBy("doc_id", "piece_no")
    ranked = items.withColumn("_rank", F.row_number().over(within) - 1).join(offsets, ["pack_id", "n_tokens", "_salt"])
    ranked = ranked.select("pack_id", "doc_id", "piece_no", "start_token", "n_tokens", (F.col("_rank") + F.col("_offset")).alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packs, lengths, ranks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 4, 5))
            where = pa.array(places.value.container(packs, lengths, ranks), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), where, *(batch.column(i) for i in range(1, 5))], names=["pack_id", "container_no", "doc_id", "piece_no", "start_token", "n_tokens"])

    return ranked.mapInArrow(run, PACKED)

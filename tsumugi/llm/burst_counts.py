"""Frequency of every distinct term by burst-trie counting.

Each task keeps a compact trie over the terms' 64-bit keys, most significant byte first.
A leaf holds the sorted remaining keys below its prefix with two counters each:
occurrences and records. A leaf that outgrows LEAF bursts into 256 children, so prefixes
adapt to where terms are dense; a task that holds more than HELD terms hands its leaves on and
starts anew. Leaves travel as packed
buffers, cut at WIRE bytes of prefix so that the leaves of all workers match although the
workers burst to different depths; one wire prefix spans 65,536 terms at most. Matching
subtrees meet in one task and are merged in a trie of the same kind, by adding the
counters of equal terms; they come sorted by prefix, and each prefix is handed on before the
next begins.

Text terms go the same way by their UTF-8 bytes. As texts may share long beginnings, a wire
prefix of theirs is the first WIRE bytes and one of FANS numbers by hash, so that a beginning
that is common to a third of all terms meets in FANS merges.

A term costs one counter pair per task at most before the shuffle, however often it
occurs, so hot terms do no harm; a leaf's size is bounded by its distinct terms.

Defined results: NULL or empty lists and elements that are NULL or outside
[least, most] do not count; a list that holds no countable element is no record. Of text
terms the empty one counts like any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 8192
HELD = 1_000_000
DEEPEST = 7  # bytes of prefix; the eighth byte is always inside the leaf
WIRE = 6  # bytes of prefix by which leaves are sent
FANS = 64  # parts of a wire prefix of text terms

LEAVES = "prefix long, terms binary, occurrences binary, records binary"
COUNTS = "term long, occurrences long, records long"


def add(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two counter tables (sorted terms, occurrences, records) merged by term."""
    terms = np.concatenate((a[0], b[0]))
    order = np.argsort(terms, kind="stable")
    terms = terms[order]
    first = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(np.concatenate((x, y))[order], first) if len(first) else np.zeros(0, np.int64) for x, y in ((a[1], b[1]), (a[2], b[2]))]
    return terms[first], sums[0], sums[1]


class BurstTrie:
    """Leaves by (depth, prefix); inner nodes are the set of burst prefixes."""

    def __init__(self) -> None:
        self.leaves: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.burst: set[tuple[int, int]] = set()
        self.held = 0

    def insert(self, table: tuple[np.ndarray, np.ndarray, np.ndarray], depth: int = 0) -> None:
        """Route a sorted table to its leaves; all its terms share their first ``depth`` bytes."""
        if not len(table[0]):
            return
        prefixes = table[0] >> np.uint64(64 - 8 * depth) if depth else np.zeros(len(table[0]), np.uint64)
        cuts = np.flatnonzero(np.concatenate(([True], prefixes[1:] != prefixes[:-1], [True])))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            key = (depth, int(prefixes[lo]))
            part = tuple(x[lo:hi] for x in table)
            if key in self.burst:
                self.insert(part, depth + 1)
                continue
            old = self.leaves.get(key)
            new = part if old is None else add(old, part)
            self.held += len(new[0]) - (0 if old is None else len(old[0]))
            if len(new[0]) > LEAF and depth < DEEPEST:
                self.leaves.pop(key, None)
                self.held -= len(new[0])
                self.burst.add(key)
                self.insert(new, depth + 1)
            else:
                self.leaves[key] = new

    def tables(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The leaves' tables in the order of their terms."""
        found = sorted(self.leaves, key=lambda leaf: leaf[1] << (64 - 8 * leaf[0]))
        return [self.leaves[leaf] for leaf in found] if found else [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def clear(self) -> None:
        self.leaves.clear()
        self.held = 0


def _sent(trie: BurstTrie) -> pa.RecordBatch:
    """The trie's leaves, cut at the wire prefix."""
    rows = []
    for table in trie.tables():
        prefixes = table[0] >> np.uint64(64 - 8 * WIRE)
        cuts = np.flatnonzero(np.concatenate(([True], prefixes[1:] != prefixes[:-1], [True]))) if len(prefixes) else []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            rows.append((int(prefixes[lo]), *(x[lo:hi].tobytes() for x in table)))
    columns = list(zip(*rows)) if rows else [[]] * 4
    types = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["prefix", "terms", "occurrences", "records"])


def _counter(least: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie()
        for batch in batches:
            lists = batch.column(0)
            row = pc.list_parent_indices(lists)
            value = pc.list_flatten(lists)
            keep = pc.fill_null(pc.and_(pc.greater_equal(value, least), pc.less_equal(value, most)), False)
            row = row.filter(keep).to_numpy(zero_copy_only=False).astype(np.uint64)
            value = value.filter(keep).to_numpy(zero_copy_only=False).astype(np.uint64)
            if not len(value):
                continue
            order = np.lexsort((row, value))
            value, row = value[order], row[order]
            new_term = np.concatenate(([True], value[1:] != value[:-1]))
            new_record = np.concatenate(([True], row[1:] != row[:-1])) | new_term
            first = np.flatnonzero(new_term)
            occurrences = np.diff(np.append(first, len(value))).astype(np.int64)
            trie.insert((value[first], occurrences, np.add.reduceat(new_record.astype(np.int64), first)))
            if trie.held > HELD:
                yield _sent(trie)
                trie.clear()
        yield _sent(trie)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the terms of each prefix; leaves come sorted by prefix."""
    trie, now = BurstTrie(), None

    def merged() -> Iterator[pa.RecordBatch]:
        for terms, occurrences, records in trie.tables():
            yield pa.RecordBatch.from_arrays([pa.array(terms.astype(np.int64)), pa.array(occurrences), pa.array(records)], names=["term", "occurrences", "records"])

    for batch in batches:
        for prefix, terms, occurrences, records in zip(*(c.to_pylist() for c in batch.columns)):
            if prefix != now and trie.held > HELD:
                yield from merged()
                trie = BurstTrie()
            now = prefix
            trie.insert((np.frombuffer(terms, np.uint64), np.frombuffer(occurrences, np.int64), np.frombuffer(records, np.int64)))
    yield from merged()


class TextTrie:
    """Counters of text terms by bytes: leaves are tables of the rest of the term, a leaf that
    outgrows LEAF bursts into one child per next byte."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.held = 0

    def insert(self, term: bytes, occurrences: int, records: int) -> None:
        node, at = self.root, 0
        while node.get("burst"):
            node = node["burst"].setdefault(term[at : at + 1], {})
            at += 1
        leaf = node.setdefault("leaf", {})
        old = leaf.get(term[at:])
        if old is None:
            self.held += 1
            leaf[term[at:]] = [occurrences, records]
            if len(leaf) > LEAF and any(leaf):
                self._burst(node)
        else:
            old[0] += occurrences
            old[1] += records

    @staticmethod
    def _burst(node: dict) -> None:
        children: dict = {}
        for rest, counters in node.pop("leaf").items():
            children.setdefault(rest[:1], {}).setdefault("leaf", {})[rest[1:]] = counters
        node["burst"] = children

    def terms(self) -> Iterator[tuple[bytes, int, int]]:
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            for rest, (occurrences, records) in node.get("leaf", {}).items():
                yield prefix + rest, occurrences, records
            stack.extend((prefix + byte, child) for byte, child in node.get("burst", {}).items())


def _count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = TextTrie()

    def sent() -> pa.RecordBatch:
        leaves: dict[tuple[bytes, int], list] = {}
        for term, occurrences, records in trie.terms():
            leaves.setdefault((term[:WIRE], zlib.crc32(term) % FANS), []).append((term, occurrences, records))
        rows = [(prefix + bytes([fan]), *zip(*found)) for (prefix, fan), found in leaves.items()]
        columns = list(zip(*rows)) if rows else [[]] * 4
        types = [pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["prefix", "terms", "occurrences", "records"])

    for batch in batches:
        lists = batch.column(0)
        row = pc.list_parent_indices(lists)
        value = pc.list_flatten(lists)
        there = pc.is_valid(value)
        encoded = value.filter(there).dictionary_encode()
        code = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = row.filter(there).to_numpy(zero_copy_only=False).astype(np.int64)
        size = len(encoded.dictionary)
        occurrences = np.bincount(code, minlength=size)
        records = np.bincount(np.unique(code * (len(lists) + 1) + row) // (len(lists) + 1), minlength=size) if size else occurrences
        for term, n, m in zip(encoded.dictionary.to_pylist(), occurrences.tolist(), records.tolist()):
            trie.insert(term.encode(), n, m)
        if trie.held > HELD:
            yield sent()
            trie = TextTrie()
    yield sent()


def _merge_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie, now = TextTrie(), None

    def merged() -> pa.RecordBatch:
        rows = [(term.decode(), occurrences, records) for term, occurrences, records in trie.terms()]
        columns = list(zip(*rows)) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["term", "occurrences", "records"])

    for batch in batches:
        for prefix, terms, occurrences, records in zip(*(c.to_pylist() for c in batch.columns)):
            if prefix != now and trie.held > HELD // 16:
                yield merged()
                trie = TextTrie()
            now = prefix
            for term, n, m in zip(terms, occurrences, records):
                trie.insert(term, n, m)
    yield merged()


def count_terms(lists: DataFrame, column: str, least: int, most: int) -> DataFrame:
    """term, occurrences and records for every distinct value in [least, most] of the array column."""
    leaves = lists.select(F.col(column).cast("array<bigint>").alias(column)).where(F.col(column).isNotNull()).mapInArrow(_counter(least, most), LEAVES)
    return leaves.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_merge, COUNTS)


def count_texts(lists: DataFrame, column: str) -> DataFrame:
    """term, occurrences and records for every distinct text of the array column."""
    leaves = lists.select(F.col(column).cast("array<string>").alias(column)).where(F.col(column).isNotNull()).mapInArrow(_count_texts, "prefix binary, terms array<binary>, occurrences array<long>, records array<long>")
    return leaves.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_merge_texts, "term string, occurrences long, records long")

"""Compiled dictionaries, vector stores and entity pools as tables.

Each file is read whole (binaryFile) and decoded with numpy in one pass; the double array is
walked level by level for all keys at once. Formats are little-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tsumugi.operators.lexicon import CONNECTION, ENTRY

# Magic numbers, sizes and the prefixes of entity sources.
DICTIONARY_MAGIC, DICTIONARY_VERSION, HEADER = 0xEF718F77, 102, 72
VECTOR_MAGIC, VECTOR_HEADER = 0x3143564D, 32
POOL_MAGIC, POOL_HEADER, POOL_ENTRY, POOL_PREFIX = b"MCSP", 20, 5, 64
TABLE_SIZE = 0xFFFF
SOURCES = {0: "http://www.wikidata.org/entity/", 1: "http://dbpedia.org/resource/", 2: "http://schema.org/", 3: ""}


def decode_dictionary(data: bytes, kind: int | None = None) -> dict:
    """Keys with their token runs, tokens and features of a compiled dictionary; ValueError if malformed."""
    if len(data) < HEADER:
        raise ValueError("dictionary too small")
    magic, version, found, _, _, _, trie_size, token_size, feature_size = struct.unpack_from("<9I", data)
    if magic ^ DICTIONARY_MAGIC != len(data):
        raise ValueError("dictionary magic does not match the file's size")
    if version != DICTIONARY_VERSION:
        raise ValueError(f"dictionary version {version}")
    if kind is not None and found != kind:
        raise ValueError(f"dictionary type {found}, expected {kind}")
    if len(data) < HEADER + trie_size + token_size + feature_size:
        raise ValueError("dictionary cut off")
    units = np.frombuffer(data, np.dtype([("base", "<i4"), ("check", "<u4")]), trie_size // 8, HEADER)
    tokens = np.frombuffer(data, np.dtype([("left", "<u2"), ("right", "<u2"), ("pos", "<u2"), ("cost", "<i2"), ("feature", "<u4"), ("compound", "<u4")]), token_size // 16, HEADER + trie_size)
    features = data[HEADER + trie_size + token_size :][:feature_size]
    keys: list[tuple[bytes, int]] = []
    level = [(b"", int(units["base"][0]))] if len(units) else []
    bases = np.array([b for _, b in level], np.int64)
    names = [n for n, _ in level]
    while len(bases):
        ends = bases < len(units)
        at = bases[ends]
        hit = (units["check"][at] == at.astype(np.uint32)) & (units["base"][at] < 0)
        which = np.flatnonzero(ends)[hit]
        keys.extend((names[i], int(-units["base"][bases[i]] - 1)) for i in which.tolist())
        grid = bases[:, None] + np.arange(256) + 1
        valid = grid < len(units)
        valid &= units["check"][np.minimum(grid, len(units) - 1)] == bases.astype(np.uint32)[:, None]
        rows, letters = np.nonzero(valid)
        names = [names[r] + bytes([c]) for r, c in zip(rows.tolist(), letters.tolist())]
        bases = units["base"][grid[rows, letters]].astype(np.int64)
        alive = bases >= 0
        names = [n for n, a in zip(names, alive.tolist()) if a]
        bases = bases[alive]
    return {"keys": keys, "tokens": tokens, "features": features}


def encode_dictionary(words: list[tuple[str, int, int, int, int, str]], kind: int = 0) -> bytes:
    """A compiled dictionary of (surface, left, right, pos, cost, feature), for tests and exchange."""
    by_key: dict[bytes, list] = {}
    for surface, *rest in words:
        by_key.setdefault(surface.encode(), []).append(rest)
    tokens, features, values = b"", b"", {}
    count = 0
    for key in sorted(by_key):
        values[key] = count << 8 | len(by_key[key])
        for left, right, pos, cost, feature in by_key[key]:
            tokens += struct.pack("<HHHhII", left, right, pos, cost, len(features), 0)
            features += feature.encode() + b"\0"
            count += 1
    children: dict[bytes, set[int]] = {}
    for key in values:
        for i in range(len(key)):
            children.setdefault(key[:i], set()).add(key[i])
    base, check, used = {0: 1}, {}, {0}
    queue = [(b"", 0)]
    size = 1
    while queue:
        prefix, node = queue.pop(0)
        slots = [c + 1 for c in sorted(children.get(prefix, ()))] + ([0] if prefix in values else [])
        b = 1
        while any(b + s in used for s in slots) or b in used:
            b += 1
        base[node] = b
        used.add(b)
        for s in slots:
            used.add(b + s)
            check[b + s] = b
            size = max(size, b + s + 1)
            if s == 0:
                base[b] = -values[prefix] - 1
            else:
                queue.append((prefix + bytes([s - 1]), b + s))
    size += 257
    trie = b"".join(struct.pack("<iI", base.get(i, 0), check.get(i, 0)) for i in range(size))
    total = HEADER + len(trie) + len(tokens) + len(features)
    head = struct.pack("<10I", total ^ DICTIONARY_MAGIC, DICTIONARY_VERSION, kind, count, 0, 0, len(trie), len(tokens), len(features), 0) + b"utf-8".ljust(32, b"\0")
    return head + trie + tokens + features


def dictionary_rows(data: bytes, kind: int | None = None) -> list[tuple]:
    """Rows of ENTRY; the word id is the token's index."""
    d = decode_dictionary(data, kind)
    rows = []
    for key, value in d["keys"]:
        for i in range(value >> 8, (value >> 8) + (value & 0xFF)):
            if i < len(d["tokens"]):
                t = d["tokens"][i]
                end = d["features"].find(b"\0", int(t["feature"]))
                text = d["features"][int(t["feature"]) : end if end >= 0 else None]
                try:
                    feature = text.decode()
                except UnicodeDecodeError:
                    feature = ""
                rows.append((key.decode("utf-8", "replace"), i, int(t["left"]), int(t["right"]), int(t["pos"]), int(t["cost"]), feature, 1))
    return rows


def matrix_rows(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(right ids, left ids, costs) of a compiled matrix."""
    left, right = struct.unpack_from("<HH", data)
    if len(data) != 4 + left * right * 2:
        raise ValueError("matrix size does not match its heading")
    costs = np.frombuffer(data, "<i2", left * right, 4)
    index = np.arange(left * right)
    return index % left, index // left, costs


def character_rows(data: bytes) -> list[tuple]:
    """(code point, category, type mask, length, group, invoke) of a compiled character table."""
    (n,) = struct.unpack_from("<I", data)
    if len(data) != 4 + 32 * n + 4 * TABLE_SIZE:
        raise ValueError("character table size does not match its heading")
    names = [data[4 + 32 * i : 36 + 32 * i].split(b"\0")[0].decode() for i in range(n)]
    packed = np.frombuffer(data, "<u4", TABLE_SIZE, 4 + 32 * n).astype(np.int64)
    kinds = (packed >> 18 & 0xFF).tolist()
    return [(i, names[k] if k < n else "DEFAULT", p & 0x3FFFF, p >> 26 & 0xF, bool(p >> 30 & 1), bool(p >> 31 & 1)) for i, (p, k) in enumerate(zip(packed.tolist(), kinds))]


VECTOR_TYPES = {0: "<f4", 1: "<f2", 2: "i1"}  # fixed values: element types of a vector store


def decode_vectors(data: bytes) -> np.ndarray:
    """The (words, dimensions) matrix of a vector store, as 32-bit floats; bytes are their number as such."""
    if len(data) < VECTOR_HEADER:
        raise ValueError("vector store too small")
    magic, words, dim, kind = struct.unpack_from("<4I", data)
    if magic != VECTOR_MAGIC or kind not in VECTOR_TYPES:
        raise ValueError("no vector store of a known element type")
    element = np.dtype(VECTOR_TYPES[kind])
    if len(data) != VECTOR_HEADER + words * dim * element.itemsize:
        raise ValueError("vector store size does not match its heading")
    return np.frombuffer(data, element, words * dim, VECTOR_HEADER).reshape(words, dim).astype(np.float32)


def encode_vectors(matrix: np.ndarray, kind: int = 0) -> bytes:
    return struct.pack("<4I16x", VECTOR_MAGIC, *matrix.shape, kind) + matrix.astype(VECTOR_TYPES[kind]).tobytes()


def pool_rows(data: bytes) -> list[tuple[int, str, float, int]]:
    """(pool id from 1, uri, confidence, source) of an entity pool."""
    if data[:4] != POOL_MAGIC:
        raise ValueError("no entity pool")
    _, count, strings, _ = struct.unpack_from("<4I", data, 4)
    rows = []
    for i in range(count):
        entry = data[POOL_HEADER + i * POOL_ENTRY :][:POOL_ENTRY]
        start = strings + int.from_bytes(entry[:3], "little")
        source = entry[4]
        rows.append((i + 1, SOURCES.get(source, "") + data[start : data.index(b"\0", start)].decode(), entry[3] / 255, source))
    return rows


def encode_pool(entries: list[tuple[str, float]]) -> bytes:
    """An entity pool of (uri, confidence); equal strings are stored once, offsets beyond 24 bits are an error."""
    strings, offsets, body = bytearray(), {}, bytearray()
    for uri, confidence in entries:
        source = next((k for k, p in SOURCES.items() if p and uri.startswith(p)), 3)
        suffix = uri[len(SOURCES[source]) :]
        if suffix not in offsets:
            offsets[suffix] = len(strings)
            strings += suffix.encode() + b"\0"
        if offsets[suffix] >= 1 << 24:
            raise ValueError("the pool's strings exceed 16 MiB; keep it as a table")
        body += offsets[suffix].to_bytes(3, "little") + bytes([int(np.float32(min(max(confidence, 0), 1)) * np.float32(255)), source])
    prefixes = POOL_HEADER + len(body)
    return POOL_MAGIC + struct.pack("<4I", 1, len(entries), prefixes + 2, prefixes) + bytes(body) + struct.pack("<H", 0) + bytes(strings)


def _decoded(spark: SparkSession, path: str, schema: str, decode) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield from decode(data)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def _rows(schema: pa.Schema, decode):
    def run(data: bytes) -> Iterator[pa.RecordBatch]:
        rows = decode(data)
        columns = list(zip(*rows)) if rows else [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def read_dictionary(spark: SparkSession, path: str, kind: int | None = None) -> DataFrame:
    """Lexicon entries of a compiled system (or with kind 2 unknown-word) dictionary."""
    schema = pa.schema([("surface", pa.string()), ("word_id", pa.int64()), ("left_id", pa.int32()), ("right_id", pa.int32()), ("pos_id", pa.int32()), ("wcost", pa.int32()), ("feature", pa.string()), ("layer", pa.int32())])
    return _decoded(spark, path, ENTRY, _rows(schema, lambda data: dictionary_rows(data, kind)))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    def run(data: bytes) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in matrix_rows(data)], names=["right_id", "left_id", "cost"])

    return _decoded(spark, path, CONNECTION, run)


def read_characters(spark: SparkSession, path: str) -> DataFrame:
    schema = pa.schema([("codepoint", pa.int32()), ("category", pa.string()), ("type_mask", pa.int32()), ("length", pa.int32()), ("group", pa.bool_()), ("invoke", pa.bool_())])
    return _decoded(spark, path, "codepoint int, category string, type_mask int, length int, group boolean, invoke boolean", _rows(schema, character_rows))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    def run(data: bytes) -> Iterator[pa.RecordBatch]:
        matrix = decode_vectors(data)
        flat = pa.array(matrix.reshape(-1), pa.float32())
        offsets = pa.array(np.arange(0, matrix.size + 1, matrix.shape[1] or 1), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(matrix)), pa.int64()), pa.ListArray.from_arrays(offsets, flat)], names=["word_id", "embedding"])

    return _decoded(spark, path, "word_id long, embedding array<float>", run)


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    schema = pa.schema([("pool_id", pa.int64()), ("uri", pa.string()), ("confidence", pa.float64()), ("source", pa.int32())])
    return _decoded(spark, path, "pool_id long, uri string, confidence double, source int", _rows(schema, pool_rows))


def write_vectors(vectors: DataFrame, path: str, max_word_id: int, dim: int) -> None:
    """A vector store file with a row for every id up to ``max_word_id``, zeros where missing.

    The format is one local file; rows stream through the driver in the order of their ids,
    one partition at a time. Larger stores stay tables.
    """
    ordered = vectors.where(f"word_id between 0 and {max_word_id}").select("word_id", "embedding").orderBy("word_id")
    empty = bytes(4 * dim)
    with open(path, "wb") as out:
        out.write(struct.pack("<4I16x", VECTOR_MAGIC, max_word_id + 1, dim, 0))
        at = 0
        for row in ordered.toLocalIterator():
            out.write(empty * (row.word_id - at))
            out.write(np.array(row.embedding, "<f4").tobytes())
            at = row.word_id + 1
        out.write(empty * (max_word_id + 1 - at))


def write_pool(entries: DataFrame, path: str) -> None:
    """An entity pool file of (pool_id, uri, confidence); the format holds 16 MiB of strings at most."""
    rows = entries.select("pool_id", "uri", "confidence").orderBy("pool_id").toLocalIterator()
    with open(path, "wb") as out:
        out.write(encode_pool([(r.uri, r.confidence) for r in rows]))

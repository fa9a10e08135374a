"""Several values packed in one field: dialects chosen by minimum description length.

A dialect is a set of delimiters with or without quoting. The description length of a
field under a dialect is the cost of its number of places, plus for each value the
cheapest of: its code in a table of frequent values, a reference to an equal earlier
value of the same field, or an escape followed by its characters. All code lengths come
from counts over every row of the input (each candidate parse of a field counts with an
equal share); a field's own parses do not vouch for its values. The counts stay a table: a field that has several candidate dialects is joined
with the counts of its values and numbers of places, whatever their frequency. Only the
characters' codes go to the tasks, one per code point that occurs.

Fields with one delimiter and without quotes have one dialect only and are split in the JVM.
Distinct fields, not rows, are counted and scored.

Defined results: NULL, empty or blank features and values that are empty or ``*`` have
no row; repeated identical rows count once; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass
from functools import reduce
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsumugi.runtime import durable, spread

# Delimiters that occur between values.
DELIMITERS = ",;|\t、，；｜"
QUOTES = "\"'"
SHARE = 5040  # a field's weight in the counts, divided among its candidate parses
REMEMBERED = 20000  # distinct features whose parse a task keeps

BLANK = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in map(chr, range(0x3001)) if c.isspace() and c != "\t") + "]"  # a tab is a delimiter
ENCLOSED = re.compile(rf"(?:^|[{DELIMITERS}])\s*([\"'])(?:(?!\1).|\1\1)*\1\s*(?:[{DELIMITERS}]|$)")
ATOMIC = re.compile(f"[^{DELIMITERS}]*")

_patterns: dict[tuple[str, bool], re.Pattern] = {}


def _pattern(delimiters: str, quoting: bool) -> re.Pattern:
    """One place with its delimiter, if the field is quoted; else only the delimiters."""
    key = (delimiters, quoting)
    if key not in _patterns:
        stop, other, blank = (f"[{re.escape(delimiters)}]", f"[^{re.escape(delimiters)}]", f"[^\\S{re.escape(delimiters)}]*") if delimiters else ("(?!)", r"[\s\S]", r"\s*")
        quoted = "\"(?:[^\"]|\"\")*\"|'(?:[^']|'')*'"
        _patterns[key] = re.compile(f"{blank}({quoted}|{other}*?){blank}({stop}|\\Z)" if quoting else stop)
    return _patterns[key]


def _unquoted(value: str) -> str:
    if len(value) > 1 and value[0] in QUOTES and value[-1] == value[0] and re.fullmatch(f"(?:[^{value[0]}]|{value[0]}{value[0]})*", value[1:-1]):
        return value[1:-1].replace(value[0] * 2, value[0]).strip()
    return value


def split(feature: str, delimiters: str, quoting: bool = True) -> list[str]:
    """Values of a field under one dialect, empty places included."""
    quotes = '"' in feature or "'" in feature
    if not quotes or not quoting:
        values = [v.strip() for v in _pattern(delimiters, False).split(feature)]
        return [_unquoted(v) for v in values] if quotes else values
    values = []
    for m in _pattern(delimiters, True).finditer(feature):
        values.append(_unquoted(m[1]))
        if not m[2]:
            break
    return values


def candidates(feature: str) -> list[tuple[str, bool]]:
    """Dialects worth scoring: every set of the delimiters present, with quoting and, unless a
    quotation fills a place (its quotes are never part of the value), without."""
    present = [d for d in DELIMITERS if d in feature]
    modes = (True, False) if any(q in feature for q in QUOTES) and not ENCLOSED.search(feature) else (True,)
    sets = [c for k in range(len(present) + 1) for c in combinations(present, k)]
    if len(sets) > 1:
        sets = sets[1:]  # a field that holds a delimiter is one value only if it is quoted as a whole
    return [("".join(s), m) for s in sets for m in modes]


class Codes:
    """Code lengths in bits, from counts of values (v), characters (c) and numbers of places (n).

    ``totals`` are the summed weights by kind and ``rare`` that of the values seen once or
    twice, where ``counts`` are not all there are.
    """

    def __init__(self, counts: list[tuple[str, str, int]], totals: dict[str, int] | None = None, rare: int | None = None):
        if totals is None:
            totals = Counter()
            for kind, _, weight in counts:
                totals[kind] += weight
            rare = sum(w for k, _, w in counts if k == "v" and w <= 2 * SHARE)
        self.totals = {k: totals.get(k, 0) + 1 for k in "vcn"}
        self.least = {k: math.log2(n * 2.0) for k, n in self.totals.items()}
        self.escape = math.log2(self.totals["v"] / (rare + (self.totals["v"] - 1) * 0.05 + 1))
        self.characters = {s: math.log2(self.totals["c"] / w) for k, s, w in counts if k == "c"}
        self.bits = self._bits(counts)
        self.spelt: dict[str, float] = {}  # of one field at a time

    def _bits(self, counts: list[tuple[str, str, int]]) -> dict[tuple[str, str], float]:
        return {(k, s): math.log2(self.totals[k] / w) for k, s, w in counts if k != "c"}

    def having(self, counts: list[tuple[str, str, int]], parsed: list[list[str]] | None = None, n: int = 0) -> Codes:
        """The same characters with the codes of these values and numbers of places only, less
        what the parses of a field add to the counts that occurs ``n`` times."""
        own = _shares(parsed) if parsed and n else {}
        other = copy(self)
        left = ((k, s, w - n * own.get((k, s), 0)) for k, s, w in counts)
        other.bits, other.spelt = self._bits([x for x in left if x[2] > 0]), {}
        return other

    def literal(self, value: str) -> float:
        cost = self.spelt.get(value)
        if cost is None:
            character, least = self.characters, self.least["c"]
            cost = self.spelt[value] = self.escape + sum(character.get(x, least) for x in value) + 4.0
        return cost

    def length(self, values: list[str], delimiters: str, quoting: bool) -> float:
        bits = self.bits.get(("n", str(len(values))), self.least["n"]) + 2.0 * len(delimiters) + (0.0 if quoting else 1.0)
        seen: set[str] = set()
        for value in values:
            known = self.bits.get(("v", value))
            cost = self.literal(value)
            if known is not None:
                cost = min(cost, known)
            if value in seen:
                cost = min(cost, self.escape + math.log2(len(values) + 1))
            seen.add(value)
            bits += cost
        return bits

    def choice(self, parsed: list[list[str]], options: list[tuple[str, bool]]) -> int:
        """Which of the parses is cheapest; of equally cheap ones the first, with the fewest delimiters."""
        lengths = [self.length(values, *option) for values, option in zip(parsed, options)]
        return lengths.index(min(lengths))

    def best(self, feature: str) -> list[str]:
        """The values under the cheapest dialect."""
        options = candidates(feature)
        parsed = [split(feature, *option) for option in options]
        return parsed[self.choice(parsed, options)]


def _shares(parsed: list[list[str]]) -> Counter:
    weight = max(1, SHARE // len(parsed))
    times = Counter(("n", str(len(values))) for values in parsed)
    times.update(("v", value) for value in chain.from_iterable(parsed))
    return Counter({key: weight * n for key, n in times.items() if key[0] == "n" or ATOMIC.fullmatch(key[1])})


def shares(feature: str) -> Counter:
    """Weights that one field adds to the counts of values without delimiters and of numbers of places.

    What holds a delimiter is spelt out, never a code of its own.
    """
    return _shares([split(feature, *option) for option in candidates(feature)])


def keys_of(feature: str) -> list[tuple[str, str]]:
    """All that the parses of a field may look up: its pieces between delimiters, and numbers of places up to theirs."""
    pieces = [split(feature, DELIMITERS, quoting) for quoting in (True, False)]
    return [("v", v) for v in dict.fromkeys(pieces[0] + pieces[1])] + [("n", str(i)) for i in range(1, len(pieces[1]) + 1)]


@dataclass(frozen=True)
class CodeBook:
    """Counts (kind, key, weight) over all fields, as a table, and the codes of characters."""

    counts: DataFrame
    codes: Codes

    def best(self, feature: str, n: int = 1) -> list[str]:
        """The values of one field that occurs ``n`` times, for inspection."""
        found = self.counts.where(F.col("key").isin([s for _, s in keys_of(feature)]) & (F.col("kind") != "c")).collect()
        options = candidates(feature)
        parsed = [split(feature, *option) for option in options]
        return parsed[self.codes.having([(r.kind, r.key, r.weight) for r in found], parsed, n).choice(parsed, options)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights of values, characters and numbers of places over distinct fields that occur n times."""
    values, characters, places = Counter(), Counter(), Counter()

    def flush() -> pa.RecordBatch:
        rows = [(k, s, w) for k, c in (("v", values), ("c", characters), ("n", places)) for s, w in c.items()]
        for c in (values, characters, places):
            c.clear()
        kinds, keys, weights = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(weights, pa.int64())], names=["kind", "key", "weight"])

    for batch in batches:
        spelt: dict[int, list[str]] = {}
        for feature, n in zip(*(c.to_pylist() for c in batch.columns)):
            options = candidates(feature)
            weight = max(1, SHARE // len(options)) * n
            texts = spelt.setdefault(weight, [])
            for option in options:
                parsed = split(feature, *option)
                places[str(len(parsed))] += weight
                texts += parsed
                for value in parsed if len(options) == 1 and '"' not in feature and "'" not in feature else filter(ATOMIC.fullmatch, parsed):
                    values[value] += weight
        for weight, texts in spelt.items():
            for x, n in Counter("".join(texts)).items():
                characters[x] += weight * n
        if len(values) > 200_000:
            yield flush()
    yield flush()


def learn_codes(fields: DataFrame, column: str = "feature") -> CodeBook:
    """Counts over all rows; of them only the characters (one row per code point) and sums reach the driver."""
    features = fields.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    counted = spread(features).mapInArrow(_count, "kind string, key string, weight long")
    counts = durable(counted.groupBy("kind", "key").agg(F.sum("weight").alias("weight")))
    rare = F.sum(F.when(F.col("weight") <= 2 * SHARE, F.col("weight")).otherwise(0))
    sums = counts.groupBy("kind", F.when(F.col("kind") == "c", F.col("key")).alias("key")).agg(F.sum("weight").alias("total"), rare.alias("rare")).collect()
    characters = [(r.kind, r.key, r.total) for r in sums if r.kind == "c"]
    totals = {r.kind: r.total for r in sums if r.kind != "c"} | {"c": sum(w for *_, w in characters)}
    return CodeBook(counts, Codes(characters, totals, next((r.rare for r in sums if r.kind == "v"), 0)))


def _plain(column: str) -> Column:
    """Whether a field has one kind of delimiter at most and no quotes, and so one dialect."""
    kinds = reduce(lambda a, b: a + b, [F.col(column).contains(d).cast("int") for d in DELIMITERS])
    return (kinds <= 1) & ~reduce(lambda a, b: a | b, [F.col(column).contains(q) for q in QUOTES])


def _fingerprint(column: str) -> list[Column]:
    """128 bits that stand for a field's text."""
    return [F.xxhash64(column).alias("_f1"), F.xxhash64(F.lit(1), F.col(column)).alias("_f2")]


def choices(features: DataFrame, book: CodeBook, column: str = "feature") -> DataFrame:
    """_f1, _f2 and the place of the cheapest candidate of every distinct field that has several."""
    shared = features.sparkSession.sparkContext.broadcast(book.codes)
    wanted = "_f1 long, _f2 long, kind string, key string, n long"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for feature, n, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if len(candidates(feature)) > 1:
                    rows.append((a, b, "f", feature, n))
                    rows.extend((a, b, *key, None) for key in keys_of(feature))
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["_f1", "_f2", "kind", "key", "n"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        for batch in batches:
            firsts, seconds, texts, ns, keys, weights = (c.to_pylist() for c in batch.columns)
            chosen = []
            for text, n, names, counted in zip(texts, ns, keys, weights):
                options = candidates(text)
                parsed = [split(text, *option) for option in options]
                chosen.append(codes.having([(k[0], k[1:], w) for k, w in zip(names, counted)], parsed, n).choice(parsed, options))
            yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.int64()), pa.array(seconds, pa.int64()), pa.array(chosen, pa.int32())], names=["_f1", "_f2", "_choice"])

    distinct = features.where(F.col(column).isNotNull() & ~_plain(column)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    asked = spread(distinct.select(column, "n", *_fingerprint(column))).mapInArrow(ask, wanted)
    found = F.col("weight").isNotNull()
    answered = asked.join(book.counts, ["kind", "key"], "left").groupBy("_f1", "_f2").agg(
        F.max(F.when(F.col("kind") == "f", F.col("key"))).alias("text"), F.max("n").alias("n"), F.collect_list(F.when(found, F.concat("kind", "key"))).alias("keys"), F.collect_list(F.when(found, F.col("weight"))).alias("weights")
    )
    return answered.mapInArrow(choose, "_f1 long, _f2 long, _choice int")


def split_packed(fields: DataFrame, book: CodeBook, keys: list[str], column: str = "feature") -> DataFrame:
    """One row per value: the ``keys`` columns, pos_no (place from 0) and item_value."""
    source = fields.select(*keys, column)
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + ", pos_no int, item_value string"
    rows = source.where(F.col(column).isNotNull() & (F.trim(column) != ""))

    plain = rows.where(_plain(column)).dropDuplicates()
    close = F.regexp_replace(F.regexp_replace(column, f"{BLANK}*([{DELIMITERS}]){BLANK}*", "$1"), f"^{BLANK}+|{BLANK}+$", "")
    plain = plain.select(*keys, F.when(F.col(column).rlike(BLANK), close).otherwise(F.col(column)).alias(column))
    # A field is split by the one delimiter it holds: patterns of one character need no compiling per row.
    values = reduce(lambda rest, d: F.when(F.col(column).contains(d), F.split(column, re.escape(d), -1)).otherwise(rest), reversed(DELIMITERS), F.array(column))
    plain = plain.select(*keys, F.posexplode(values).alias("pos_no", "item_value")).where((F.col("item_value") != "") & (F.col("item_value") != "*"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, int | None], list[tuple[int, str]]] = {}
        for batch in batches:
            parsed = []
            for field in zip(*(batch.column(len(keys) + i).to_pylist() for i in range(2))):
                if (hit := known.get(field)) is None:
                    hit = [(i, v) for i, v in enumerate(split(field[0], *candidates(field[0])[field[1] or 0])) if v and v != "*"]
                    if len(known) < REMEMBERED:
                        known[field] = hit
                parsed.append(hit)
            at = pa.array(np.repeat(np.arange(len(parsed)), np.fromiter(map(len, parsed), np.int64, len(parsed))))
            places = pa.array([p for hit in parsed for p, _ in hit], pa.int32())
            values = pa.array([v for hit in parsed for _, v in hit], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(keys))), places, values], names=[*keys, "pos_no", "item_value"])

    several = rows.where(~_plain(column)).dropDuplicates().select(*keys, column, *_fingerprint(column))
    chosen = several.join(choices(source, book, column), ["_f1", "_f2"], "left").select(*keys, column, "_choice")
    return plain.unionByName(chosen.mapInArrow(run, out))

"""Rows that fail to parse: a quote-aware finite-state tokenizer over raw records.

Every record is run through a five-state automaton. The state reached after each
character is found without a character loop: the text of a whole batch is cut into
chunks, each chunk's transition function (start state -> end state, for all start
states at once) is built with vectorised table look-ups, the functions are composed
from chunk to chunk, and a second vectorised pass fills in the states. One very long
record therefore costs no more than many short ones.

Defined results: a NULL line is no record (no row); a user line that is blank or starts
with ``#`` is no record; an unknown ``kind`` is read with the user layout; repeated
identical rows give one row; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsumugi.runtime import numbered, spread

# States: start of a field, in a plain field, in a quoted field, after a quote inside a
# quoted field, malformed.
START, PLAIN, QUOTED, CLOSED, BROKEN = range(5)
DELIMITER, QUOTE, OTHER, END, NOTHING, NEWLINE = range(6)
NEXT = np.array(
    [
        [START, START, QUOTED, START, BROKEN],  # delimiter
        [QUOTED, BROKEN, CLOSED, QUOTED, BROKEN],  # quote
        [PLAIN, PLAIN, QUOTED, BROKEN, BROKEN],  # any other character
        [START, START, START, START, START],  # end of the record
        [START, PLAIN, QUOTED, CLOSED, BROKEN],  # padding
        [START, START, QUOTED, START, START],  # line break in a file: ends a record outside quotations
    ],
    dtype=np.uint8,
)
CHUNK = 256

# The parts of speech that may stand first in a dictionary entry.
POS_HEADS = frozenset("名詞 動詞 形容詞 副詞 助詞 助動詞 連体詞 接続詞 感動詞 記号 接頭詞 フィラー その他".split())
COST = re.compile(r"[+-]?[0-9]+\Z")

PARSED = (
    "row_id long, kind string, reason string, error_at int, surface string, reading string, pronunciation string, "
    "left_id int, right_id int, cost int, pos array<string>, base string"
)


def compose(classes: np.ndarray, start: int = START, chunk: int = CHUNK) -> tuple[np.ndarray, int]:
    """State after each character, and the last state, for characters given by class.

    ``start`` is the state in which the text begins, so texts that arrive in pieces can be
    run piece by piece: the last state of one is the start of the next.
    """
    n = len(classes)
    if not n:
        return np.empty(0, np.uint8), start
    rows = -(-n // chunk)
    grid = np.full(rows * chunk, NOTHING, np.uint8)
    grid[:n] = classes
    grid = grid.reshape(rows, chunk)
    maps = np.tile(np.arange(5, dtype=np.uint8), (rows, 1))
    for j in range(chunk):
        maps = NEXT[grid[:, j][:, None], maps]
    begin = np.empty(rows, np.uint8)
    state = start
    for i in range(rows):
        begin[i] = state
        state = int(maps[i, state])
    states = np.empty((rows, chunk), np.uint8)
    now = begin
    for j in range(chunk):
        now = NEXT[grid[:, j], now]
        states[:, j] = now
    return states.reshape(-1)[:n], state


def tokenize(lines: list[str], delimiter: str = ",", quote: str = '"') -> tuple[list[list[str]], list[int]]:
    """Fields of every record, and the offset of its first malformed character (-1: well-formed).

    A quotation that is never closed is an error at the record's length.
    """
    if not lines:
        return [], []
    text = "\n".join(lines) + "\n"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in lines), np.int64, len(lines))) - 1
    classes = np.full(len(points), OTHER, np.uint8)
    classes[points == ord(delimiter)] = DELIMITER
    classes[points == ord(quote)] = QUOTE
    classes[ends] = END
    states, _ = compose(classes)
    begins = np.concatenate(([0], ends[:-1] + 1))
    before = np.where(ends > begins, states[np.maximum(ends - 1, 0)], START)
    broken_at = np.full(len(lines), -1, np.int64)
    bad = np.flatnonzero(states == BROKEN)
    owner = np.searchsorted(ends, bad)
    broken_at[owner[::-1]] = (bad - begins[owner])[::-1]
    broken_at = np.where(before == QUOTED, ends - begins, broken_at)
    cuts = np.flatnonzero(((classes == DELIMITER) & (states == START)) | (classes == END))
    last = np.searchsorted(cuts, ends)
    fields: list[list[str]] = []
    position = 0
    first = 0
    for upto in last.tolist():
        row = []
        for cut in cuts[first : upto + 1].tolist():
            value = text[position:cut]
            row.append(value[1:-1].replace(quote * 2, quote) if value[:1] == quote else value)
            position = cut + 1
        fields.append(row)
        first = upto + 1
    return fields, broken_at.tolist()


def records(text: str, delimiter: str = ",", quote: str = '"') -> list[tuple[int, str]]:
    """Offset and text of every record of a file: records end at line breaks outside quotations.

    The states at all line breaks come from the chunks' transition functions. A quotation that
    is never closed reaches to the end of the file; that record fails for its quoting.
    """
    if not text:
        return []
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = np.full(len(points), OTHER, np.uint8)
    classes[points == ord(delimiter)] = DELIMITER
    classes[points == ord(quote)] = QUOTE
    classes[points == 10] = NEWLINE
    states, _ = compose(classes)
    ends = np.flatnonzero((points == 10) & (states != QUOTED)).tolist()
    starts = [0, *(e + 1 for e in ends)]
    return [(a, text[a:b].removesuffix("\r")) for a, b in zip(starts, [*ends, len(text)]) if a < len(text)]


def _whole(value: str) -> int | None:
    return int(value) if COST.match(value) and len(value) < 10 else None


def judge(kind: str, fields: list[str], error_at: int) -> tuple:
    """(reason, error_at, surface, reading, pronunciation, left_id, right_id, cost, pos, base)."""
    nothing = (None,) * 8
    if error_at >= 0:
        return ("quoting", error_at, *nothing)
    source = kind == "source"
    if len(fields) != 13 if source else len(fields) not in (4, 10):
        return ("columns", None, *nothing)
    raw = fields[3]
    cost = int(raw) if COST.match(raw) and len(raw.lstrip("+-0")) < 6 else None
    if cost is None or not -32768 <= cost <= 32767:
        return ("cost", None, *nothing)
    pos = fields[4:10]
    if pos and (not all(pos) or pos[0] not in POS_HEADS):
        return ("pos", None, *nothing)
    if not fields[0].strip():
        return ("surface", None, *nothing)
    if source:
        return (None, None, fields[0], fields[11], fields[12], _whole(fields[1]), _whole(fields[2]), cost, pos, fields[10])
    return (None, None, fields[0], fields[1], fields[2], None, None, cost, pos or None, None)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("row_id", pa.int64()), ("kind", pa.string()), ("reason", pa.string()), ("error_at", pa.int32()), ("surface", pa.string()), ("reading", pa.string()), ("pronunciation", pa.string())]
        + [("left_id", pa.int32()), ("right_id", pa.int32()), ("cost", pa.int32()), ("pos", pa.list_(pa.string())), ("base", pa.string())]
    )
    for batch in batches:
        ids, kinds, lines = (batch.column(i).to_pylist() for i in range(3))
        fields, broken = tokenize(lines)
        rows = [(i, k, *judge(k, f, b)) for i, k, f, b in zip(ids, kinds, fields, broken)]
        columns = list(zip(*rows)) if rows else [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def read_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Raw records of dictionary files as parse_dictionary_lines takes them: row_id, kind, line, and file and offset.

    A file is read by one task; row ids rise with the offset within it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns)):
                found = records(data.decode("utf-8", "replace"))
                columns = [pa.array([name] * len(found), pa.string()), pa.array([a for a, _ in found], pa.int64()), pa.array([x for _, x in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "offset", "line"])

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, offset long, line string")
    return numbered(rows, [F.col("file"), F.col("offset")], "row_id", 1).select("row_id", F.lit(kind).alias("kind"), "line", "file", "offset")


def parse_dictionary_lines(lines: DataFrame) -> DataFrame:
    """Loaded entries (reason NULL) and rejected lines (reason set) of raw dictionary lines.

    Input: row_id, kind (``user`` or ``source``), line. ``error_at`` is the offset, in
    characters of the record, at which quoting went wrong.
    """
    records = lines.select(F.col("row_id").cast("long"), "kind", "line").where(F.col("line").isNotNull())
    comment = (F.col("kind") == "user") & (F.col("line").startswith("#") | ~F.col("line").rlike(r"(?U)[^\s]"))
    records = records.where(~F.coalesce(comment, F.lit(False))).dropDuplicates(["row_id", "kind", "line"])
    return spread(records).mapInArrow(_parse, PARSED)

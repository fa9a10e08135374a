"""Sentences of live streams: unfinished text waits in the state of its stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from tsumugi.operators.segments import JAPANESE

OUTPUT = "stream_id long, sentence string, finished boolean"
STATE = "pending string, next_no long, waiting string"


def cut(pending: str, text: str, boundary: str) -> tuple[list[str], str]:
    """Sentences that are complete after ``text`` came in, and what is still pending; blank ones are dropped."""
    done, start = [], 0
    joined = pending + text
    for i in range(len(pending), len(joined)):
        if joined[i] in boundary:
            if joined[start : i + 1].strip():
                done.append(joined[start : i + 1])
            start = i + 1
    return done, joined[start:]


class SentenceBuffer:
    """One stream's pieces on their way to sentences."""

    def __init__(self, boundary: str = JAPANESE, pending: str = "") -> None:
        self.boundary, self.pending = boundary, pending

    def push(self, text: str) -> list[str]:
        done, self.pending = cut(self.pending, text, self.boundary)
        return done

    def flush(self) -> str | None:
        """The rest as a sentence, None if it is blank."""
        rest, self.pending = self.pending, ""
        return rest if rest.strip() else None

    @property
    def has_pending(self) -> bool:
        return bool(self.pending)

    @property
    def pending_len(self) -> int:
        """Bytes of the rest."""
        return len(self.pending.encode())

    def clear(self) -> None:
        self.pending = ""


def stream_sentences(reads: DataFrame, boundary: str = JAPANESE, patience: str = "10 minutes", time: str = "read_at") -> DataFrame:
    """Sentences of (stream_id, read_no, text, read_at) as they complete.

    Pieces are taken in order of read_no, from 0, in whatever trigger they arrive: a piece that
    comes before its predecessors waits in the state. The first of pieces with one read_no
    counts. A stream that stays silent beyond the watermark hands on what waits, over gaps and
    with pieces without a read_no last, and its rest, unfinished; pieces later than the
    watermark are dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, next_no, kept = state.get if state.exists else ("", 0, "[]")
        waiting = {no: text for no, text in json.loads(kept) if no is not None}
        loose = [text for no, text in json.loads(kept) if no is None]
        buffer = SentenceBuffer(boundary, pending)
        if state.hasTimedOut:
            state.remove()
            done = [s for no in sorted(waiting) for s in buffer.push(waiting[no])] + [s for text in loose for s in buffer.push(text)]
            rest = buffer.flush()
            ends = [True] * len(done) + [False] * (rest is not None)
            if ends:
                yield pd.DataFrame({"stream_id": [key[0]] * len(ends), "sentence": done + [rest] * (rest is not None), "finished": ends})
            return
        rows = pd.concat(list(batches))
        for no, text in zip(rows["read_no"], rows["text"].fillna("")):
            if pd.isna(no):
                loose.append(text)
            elif no >= next_no:
                waiting.setdefault(int(no), text)
        done: list[str] = []
        while next_no in waiting:
            done += buffer.push(waiting.pop(next_no))
            next_no += 1
        state.update((buffer.pending, next_no, json.dumps([*waiting.items(), *((None, text) for text in loose)], ensure_ascii=False)))
        last = rows[time].max()  # NaT if no piece has a time: then the watermark alone decides
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0 if pd.isna(last) else int(last.timestamp() * 1000)) + 1)
        yield pd.DataFrame({"stream_id": [key[0]] * len(done), "sentence": done, "finished": [True] * len(done)})

    timed = reads.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, patience)
    return timed.groupBy("stream_id").applyInPandasWithState(step, OUTPUT, STATE, "append", "EventTimeTimeout")


def event_rates(events: DataFrame, width: str = "5 minutes", patience: str = "10 minutes") -> DataFrame:
    """Events and sum of values per type in tumbling windows, late ones within the watermark included."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", patience)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("window.start", "event_type", "n", "total")

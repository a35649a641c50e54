"""Removing thinking spans from token streams, where tags may straddle pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clausewise.session import ship

OPEN, CLOSE = "<think>", "</think>"


class TagFilter:
    """Text outside spans, as soon as it can't be part of a tag any more."""

    def __init__(self, held: str = "", inside: bool = False):
        self.held, self.inside = held, inside

    def feed(self, piece: str) -> str:
        self.held += piece
        out = []
        while True:
            tag = CLOSE if self.inside else OPEN
            before, found, after = self.held.partition(tag)
            if found:
                out.append("" if self.inside else before)
                self.held, self.inside = after, not self.inside
                continue
            # what could still become the tag is held back
            keep = next((k for k in range(min(len(tag) - 1, len(before)), 0, -1) if tag.startswith(before[-k:])), 0)
            if not self.inside:
                out.append(before[: len(before) - keep])
            self.held = before[len(before) - keep :] if keep else ""
            return "".join(out)

    def finish(self) -> str:
        """The rest of a stream: nothing, if a span never closed."""
        rest, self.held = ("" if self.inside else self.held), ""
        return rest


def filter_stream(tokens: DataFrame, idle: str | None = None) -> DataFrame:
    """(stream_id, seq, piece) of a stream of (stream_id string, seq int, piece string, done boolean) rows, without thinking spans.

    One small state per open stream: what is held back and whether a span is open.
    A row with ``done`` flushes and ends a stream.  One that gets no row for ``idle`` (as
    "10 minutes") is taken for abandoned: what is held back leaves under the number after its last row's,
    and its state goes, so no state outlives its stream; rows that come later begin a
    stream anew.  Waiting needs batches without rows, so a live query takes ``idle`` and a
    trigger interval; one that ends when its input does (``availableNow``) takes none, as it
    would never end.  Rows of a stream must arrive in
    order of ``seq`` from batch to batch; within a batch they are sorted.
    """
    ship(tokens.sparkSession)
    wait = _milliseconds(idle) if idle else 0
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held, inside, last = state.get
            state.remove()
            rest = TagFilter(held, inside).finish()
            yield pd.DataFrame([(key[0], last + 1, rest)] if rest else [], columns=["stream_id", "seq", "piece"])
            return
        held, inside, last = state.get if state.exists else ("", False, -1)
        filter_ = TagFilter(held, inside)
        rows, ended = [], False
        for row in pd.concat(list(frames)).sort_values("seq").itertuples():
            text, last = filter_.feed(row.piece or ""), int(row.seq)
            if row.done:
                text, ended = text + filter_.finish(), True
            if text:
                rows.append((key[0], int(row.seq), text))
        if ended:
            state.remove()
        else:
            state.update((filter_.held, filter_.inside, last))
            if wait:
                state.setTimeoutDuration(wait)
        yield pd.DataFrame(rows, columns=["stream_id", "seq", "piece"])

    return tokens.groupBy("stream_id").applyInPandasWithState(
        step, "stream_id string, seq int, piece string", "held string, inside boolean, last int", "append", timeout
    )


def _milliseconds(duration: str) -> int:
    number, unit = duration.split()
    return int(float(number) * {"second": 1000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")])


def filter_batch(tokens: DataFrame) -> DataFrame:
    """(stream_id, text): the same for streams that are complete; a span that never closes is dropped."""
    lists = tokens.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("x"))
    whole = F.array_join(F.transform("x", lambda y: F.coalesce(y["piece"], F.lit(""))), "")
    closed = F.regexp_replace(whole, r"(?s)<think>.*?</think>", "")
    return lists.select("stream_id", F.regexp_replace(closed, r"(?s)<think>.*$", "").alias("text"))


def append_log(exchanges: DataFrame, path: str, checkpoint: str):
    """Starts a stream that appends exchanges (time, user, question, answer, sources) to the audit log by day.

    Each exchange is there once, whatever fails: the checkpoint says which input a batch
    was, and the log's own list of files, by which Spark reads the folder, takes a
    batch that is run again after a restart only if it isn't in it.
    """
    rows = exchanges.withColumn("dt", F.to_date("time"))
    return rows.writeStream.format("json").partitionBy("dt").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

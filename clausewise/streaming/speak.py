"""Answers that leave piece by piece, micro-batch by micro-batch, while they are spoken."""

from __future__ import annotations

import time
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clausewise.plans.llm import LLM
from clausewise.session import ship

#: Answers that this worker is in the middle of: (pieces given, the rest) by run, question and prompt.
_open: dict[tuple, tuple[int, Iterator[str]]] = {}
MOST_OPEN = 256


def _resumed(key: tuple, given: int, start) -> Iterator[str]:
    """The rest of an answer after ``given`` pieces: the one that is open here, or a new one from there on."""
    at, rest = _open.pop(key, (-1, iter(())))
    return rest if at == given else islice(start(), given, None)


def speak(prompts: DataFrame, llm: LLM, system: str, *, seconds: float = 1.0, pieces: int = 64, run: str = "") -> DataFrame:
    """(query_id, seq, piece, done) of a stream of (query_id string, prompt string) rows.

    Each micro-batch continues every open answer for ``seconds`` or ``pieces`` pieces and
    passes on what came, so the first pieces are out long before the last are
    made.  The state of a question is its prompt and the number of pieces given; it drives the
    next micro-batch by a timeout and goes with the last piece, which has ``done``; so
    the query is a live one, which runs until it is stopped.  The back end's answer stays open
    in the worker between batches.  A worker that doesn't have it (after a lost executor or a
    restart) asks again and leaves out as many pieces as were given, so back ends have to
    answer alike each time, as those of ``plans.llm`` do at temperature zero.  A back end that fails
    ends its answer with what was given.  ``run`` tells runs apart that share workers.  A question that is asked twice
    under one id is answered once, as long as it is open.
    """
    ship(prompts.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            prompt, given = state.get
        else:
            prompt, given = next(p for f in frames for p in f["prompt"]), 0
        mark = (run, key[0], prompt)
        rest = _resumed(mark, given, lambda: llm.stream_chat(system, prompt, True))
        rows, ended, until = [], False, time.monotonic() + seconds
        while len(rows) < pieces and (not rows or time.monotonic() < until):
            try:
                rows.append((key[0], given, next(rest), False))
                given += 1
            except Exception:  # noqa: BLE001 - the end of the answer, or a back end that failed
                ended = True
                break
        if ended:
            rows.append((key[0], given, "", True))
            if state.exists:
                state.remove()
        else:
            while len(_open) >= MOST_OPEN:
                _open.pop(next(iter(_open)))
            _open[mark] = (given, rest)
            state.update((prompt, given))
            state.setTimeoutDuration(1)
        yield pd.DataFrame(rows, columns=["query_id", "seq", "piece", "done"])

    rows = prompts.select(F.col("query_id").cast("string").alias("query_id"), F.coalesce("prompt", F.lit("")).alias("prompt"))
    return rows.groupBy("query_id").applyInPandasWithState(
        step, "query_id string, seq int, piece string, done boolean", "prompt string, given int", "append", GroupStateTimeout.ProcessingTimeTimeout
    )

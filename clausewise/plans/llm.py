"""Generation back ends behind one protocol. Only the deterministic one is needed by tests and plans."""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.functions.text import THINK_SPAN
from clausewise.session import ship
from clausewise.streaming.tags import TagFilter

# Budgets of tokens, and options of the local server's interface.
MAX_TOKENS, MAX_TOKENS_REASONING = 1500, 24000
LOCAL_OPTIONS = {"temperature": 0.0, "seed": 42, "repeat_penalty": 1.15, "repeat_last_n": 256, "num_ctx": 16384}
EXHAUSTED = "The model used up its budget before it answered. Ask again, or ask a narrower question."


class LLM(Protocol):
    def chat(self, system: str, user: str, reasoning: bool = False) -> str: ...

    def stream_chat(self, system: str, user: str, reasoning: bool = False) -> Iterator[str]: ...


class Echo:
    """Answers with the prompt."""

    def chat(self, system: str, user: str, reasoning: bool = False) -> str:
        return "[echo] " + user

    def stream_chat(self, system: str, user: str, reasoning: bool = False) -> Iterator[str]:
        yield self.chat(system, user, reasoning)


def post(url: str, body: dict, headers: dict | None = None, timeout: int = 120, retries: int = 2) -> bytes:
    """A POST that is tried again, after a growing pause, if the connection fails."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | (headers or {}))  # noqa: S310
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:  # noqa: S310
                return r.read()
        except urllib.error.HTTPError:
            raise
        except OSError:
            if attempt == retries:
                raise
            time.sleep(1.5 * (attempt + 1))
    raise AssertionError


def lines_of(url: str, body: dict, headers: dict | None = None, timeout: int = 120) -> Iterator[bytes]:
    """The lines of a streamed answer to a POST, as they come."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | (headers or {}))  # noqa: S310
    with urllib.request.urlopen(request, timeout=timeout) as r:  # noqa: S310
        yield from r


def event_pieces(lines: Iterable[bytes]) -> Iterator[str]:
    """Text of server-sent events of the chat-completions interface, up to its end mark."""
    for line in lines:
        name, _, data = line.strip().partition(b":")
        if name != b"data":
            continue
        if data.strip() == b"[DONE]":
            return
        for choice in json.loads(data).get("choices") or ():
            if piece := (choice.get("delta") or {}).get("content"):
                yield piece


def object_pieces(lines: Iterable[bytes]) -> Iterator[str]:
    """Text of one JSON object a line, up to the one that says it is done."""
    for line in filter(None, map(bytes.strip, lines)):
        said = json.loads(line)
        if piece := (said.get("message") or {}).get("content"):
            yield piece
        if said.get("done"):
            return


def spoken(content: str | None) -> str:
    """What a model says without its thoughts; nothing at all means that they used up the budget."""
    return EXHAUSTED if content is None else re.sub(THINK_SPAN, "", content).strip()


def aloud(pieces: Iterable[str]) -> Iterator[str]:
    """Streamed pieces without thoughts."""
    kept = TagFilter()
    for piece in pieces:
        if text := kept.feed(piece):
            yield text
    if rest := kept.finish():
        yield rest


def _messages(system: str, user: str) -> list[dict]:
    return [{"role": "system", "content": system}, {"role": "user", "content": user}]


class Chat:
    """A server with the common chat-completions interface."""

    def __init__(self, base_url: str, model: str, api_key: str = ""):
        self.url, self.model = f"{base_url.rstrip('/')}/chat/completions", model
        self.headers = {"Authorization": f"Bearer {api_key}"}

    def body(self, system: str, user: str, reasoning: bool = False, stream: bool = False) -> dict:
        return {"model": self.model, "messages": _messages(system, user), "temperature": 0.0, "seed": 42, "stream": stream, "max_tokens": MAX_TOKENS_REASONING if reasoning else MAX_TOKENS}

    def chat(self, system: str, user: str, reasoning: bool = False) -> str:
        raw = post(self.url, self.body(system, user, reasoning), self.headers, 300 if reasoning else 120)
        return spoken(json.loads(raw)["choices"][0]["message"].get("content"))

    def stream_chat(self, system: str, user: str, reasoning: bool = False) -> Iterator[str]:
        return aloud(event_pieces(lines_of(self.url, self.body(system, user, reasoning, True), self.headers, 300 if reasoning else 120)))


class Local:
    """A model server on this network that answers with JSON objects, one a line when it streams."""

    def __init__(self, base_url: str, model: str):
        self.base_url, self.model = base_url.rstrip("/"), model

    def body(self, system: str, user: str, reasoning: bool = False, stream: bool = False) -> dict:
        options = LOCAL_OPTIONS | {"num_predict": MAX_TOKENS_REASONING if reasoning else MAX_TOKENS}
        return {"model": self.model, "messages": _messages(system, user), "stream": stream, "think": reasoning, "options": options}

    def chat(self, system: str, user: str, reasoning: bool = False) -> str:
        return spoken(json.loads(post(f"{self.base_url}/api/chat", self.body(system, user, reasoning), timeout=600, retries=0))["message"]["content"])

    def stream_chat(self, system: str, user: str, reasoning: bool = False) -> Iterator[str]:
        return aloud(object_pieces(lines_of(f"{self.base_url}/api/chat", self.body(system, user, reasoning, True), timeout=600)))

    def is_available(self) -> bool:
        try:
            with urllib.request.urlopen(f"{self.base_url}/api/tags", timeout=3) as r:  # noqa: S310
                return r.status < 400
        except OSError:
            return False


def backend() -> LLM:
    """The configured chat-completions server, else a configured local one that answers, else the deterministic back end."""
    url, model = os.environ.get("CLAUSEWISE_LLM_URL"), os.environ.get("CLAUSEWISE_LLM_MODEL")
    if url and model:
        return Chat(url, model, os.environ.get("CLAUSEWISE_LLM_KEY", ""))
    local = os.environ.get("CLAUSEWISE_LOCAL_URL")
    if local and model and (server := Local(local, model)).is_available():
        return server
    return Echo()


REWRITE = (
    "Rewrite the question as a short English search query in the terms that a regulation would use. Leave out names of "
    "regulations and articles, keep the subject, the actor and the event. Answer with the query alone."
)
DECOMPOSE = (
    "List the separate legal questions that this scenario raises, at most five, one per line, each complete in itself. "
    "Cover every duty, deadline, transfer and party that it mentions, and add none that it does not."
)
TRIAGE = (
    "Which of DORA, GDPR, KVKK, BDDK does this situation touch? Financial firms and their providers: DORA; personal data in the "
    "Union: GDPR; personal data in Turkey: KVKK; banks in Turkey: BDDK. Answer with a comma-separated list, or NONE."
)


def attempt(llm: LLM, system: str, text: str, tries: int = 2, accept: Callable[[str, str], bool] | None = None) -> str | None:
    """A model's short answer: failures and empty ones are tried again, and so are ones that aren't accepted, of which the first is better than none."""
    second_best = None
    for _ in range(tries):
        try:
            found = (llm.chat(system, text) or "").strip()
        except Exception:  # noqa: BLE001 - whatever a back end raises, the plan has a fallback
            continue
        if not found or found == EXHAUSTED:
            continue
        if accept is None or accept(text, found):
            return found
        second_best = second_best or found
    return second_best


def suggest(rows: DataFrame, llm: LLM, system: str, text: str, out: str, *, need: Column | None = None, tries: int = 2, accept=None) -> DataFrame:
    """``rows`` with a model's answer to ``text`` as column ``out`` where ``need`` holds, else null; the deterministic back end suggests nothing."""
    if isinstance(llm, Echo):
        return rows.withColumn(out, F.lit(None).cast("string"))
    ship(rows.sparkSession)
    flagged = rows.withColumn(out, F.when(F.lit(True) if need is None else need, F.col(text)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame[out] = [None if t is None else attempt(llm, system, t, tries, accept) for t in frame[out]]
            yield frame

    return flagged.mapInPandas(run, flagged.schema)


def generate(prompts: DataFrame, llm: LLM, system: str) -> DataFrame:
    """(query_id, answer) of (query_id, prompt): one call a row, in the executors."""
    ship(prompts.sparkSession)
    kind = prompts.schema["query_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"query_id": frame["query_id"], "answer": [llm.chat(system, p, True) for p in frame["prompt"]]})

    return prompts.select("query_id", "prompt").mapInPandas(run, f"query_id {kind}, answer string")


def generate_pieces(prompts: DataFrame, llm: LLM, system: str) -> DataFrame:
    """(query_id, seq, piece) of (query_id, prompt): the pieces of each streamed answer in order."""
    ship(prompts.sparkSession)
    kind = prompts.schema["query_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for query_id, prompt in zip(frame["query_id"], frame["prompt"], strict=True):
                # each piece leaves at once, so no answer is gathered
                for seq, piece in enumerate(llm.stream_chat(system, prompt, True)):
                    yield pd.DataFrame({"query_id": [query_id], "seq": [seq], "piece": [piece]})

    return prompts.select("query_id", "prompt").mapInPandas(run, f"query_id {kind}, seq int, piece string")

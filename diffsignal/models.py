"""Ports for embedding and language models, run batch by batch inside tasks; deterministic local ones are built in."""

from __future__ import annotations

import hashlib
import queue
import re
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

# Texts a request and requests at once, by provider.
BATCH, CONCURRENCY = {"openai": 512, "google": 100, "ollama": 32}, {"openai": 6, "google": 1, "ollama": 1}
#: Estimated tokens and inputs of one embedding request, trailing window in seconds, share of the budget used, retries.
REQUEST_TOKENS, REQUEST_INPUTS, WINDOW_S, HEADROOM, RETRIES = 150_000, 2048, 60, 0.9, 6

#: Seconds to wait where a refusal does not tell, and the length to which an input that is too long is cut at most.
WAIT_S, LEAST_CHARS = 2.0, 256
# How providers' rate-limit messages tell the limit and the wait.
LIMIT_TOLD, WAIT_TOLD = r"Limit[: ]+(\d+)", r"try again in ([\d.]+)s"


class Embedder(Protocol):
    dimension: int
    max_chars: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class Reply:
    text: str
    prompt_tokens: int | None = None
    completion_tokens: int | None = None


class Model(Protocol):
    def generate(self, prompt: str) -> Reply: ...


@dataclass(frozen=True)
class HashEmbedder:
    """The bytes of MD5 as fractions; equal texts get equal vectors."""

    dimension: int = 16
    max_chars: int = 3000

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[b / 255 for b in hashlib.md5(t[: self.max_chars].encode()).digest()[: self.dimension]] for t in texts]


@dataclass(frozen=True)
class CannedModel:
    """Answers every prompt with what ``answer`` makes of it."""

    answer: Callable[[str], str]

    def generate(self, prompt: str) -> Reply:
        text = self.answer(prompt)
        return Reply(text, -(-len(prompt) // 2), -(-len(text) // 2))


EMBEDDERS: dict[str, Callable[..., Embedder]] = {"local": HashEmbedder}
MODELS: dict[str, Callable[..., Model]] = {"local": CannedModel}


def embedder_for(provider: str, **options: object) -> Embedder:
    """One registry serves indexing and review alike; network adapters register here."""
    if provider not in EMBEDDERS:
        raise ValueError(f"no embedder for {provider}")
    return EMBEDDERS[provider](**options)


def model_for(provider: str, **options: object) -> Model:
    if provider not in MODELS:
        raise ValueError(f"no model for {provider}")
    return MODELS[provider](**options)


def request_packs(texts: list[str], tokens: int = REQUEST_TOKENS, inputs: int = REQUEST_INPUTS) -> list[list[str]]:
    """Texts in order, as requests within both limits; a larger text goes alone."""
    out: list[list[str]] = []
    held = 0
    for t in texts:
        n = -(-len(t) // 2)
        if not out or held + n > tokens or len(out[-1]) >= inputs:
            out.append([])
            held = 0
        out[-1].append(t)
        held += n
    return out


class TokenBudget:
    """Pacing of one worker's requests by what it spent in the trailing window; a rate-limit reply teaches the limit."""

    def __init__(self, limit: int = 800_000, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.budget, self.clock, self.sleep, self.spent = limit, clock, sleep, []

    def admit(self, tokens: int) -> None:
        """Wait until the request fits or the window is empty, then note it."""
        while True:
            now = self.clock()
            self.spent = [(at, n) for at, n in self.spent if now - at <= WINDOW_S]
            if not self.spent or sum(n for _, n in self.spent) + tokens <= self.budget:
                self.spent.append((now, tokens))
                return
            self.sleep(max(0.05, WINDOW_S - (now - self.spent[0][0])))

    def learn(self, limit: int) -> None:
        self.budget = int(limit * HEADROOM)


def with_retries(model: Model, times: int = 2, pause_ms: int = 200, sleep: Callable[[float], None] = time.sleep) -> Model:
    """A model that tries again after an error, with a pause that grows each time."""

    @dataclass(frozen=True)
    class Retrying:
        inner: Model

        def generate(self, prompt: str) -> Reply:
            for i in range(times + 1):
                try:
                    return self.inner.generate(prompt)
                except Exception:
                    if i == times:
                        raise
                    sleep(pause_ms * (i + 1) / 1000)
            raise AssertionError

    return Retrying(model)


def within(seconds: float, call: Callable, *args, cancel: Callable[[], None] | None = None):
    """What ``call(*args)`` gives, or TimeoutError when ``seconds`` are over; then ``cancel`` is called and the call's thread is left behind.

    The thread is a daemon: one that never comes back holds up neither the task
    nor the worker's end.
    """
    if seconds <= 0:
        raise TimeoutError("no time is left for a call")
    done: queue.SimpleQueue = queue.SimpleQueue()

    def work() -> None:
        try:
            done.put((call(*args), None))
        except BaseException as error:
            done.put((None, error))

    threading.Thread(target=work, daemon=True).start()
    try:
        value, error = done.get(timeout=seconds)
    except queue.Empty:
        if cancel:
            cancel()
        raise TimeoutError(f"no answer within {seconds} s") from None
    if error is not None:
        raise error
    return value


def with_timeout(model: Model, seconds: float) -> Model:
    """A model whose calls end after ``seconds``, answered or not; its ``cancel``, if it has one, is told of each that did not."""

    @dataclass(frozen=True)
    class Timed:
        inner: Model

        def generate(self, prompt: str) -> Reply:
            return within(seconds, self.inner.generate, prompt, cancel=getattr(self.inner, "cancel", None))

    return Timed(model)


def each(call: Callable, items: list, threads: int) -> list:
    """``call`` of every item, in order, by some threads of the task at once; ``call`` must not raise."""
    if threads <= 1 or len(items) <= 1:
        return [call(i) for i in items]
    out: list = [None] * len(items)
    left = iter(range(len(items)))
    lock = threading.Lock()

    def work() -> None:
        while True:
            with lock:
                i = next(left, None)
            if i is None:
                return
            out[i] = call(items[i])

    pool = [threading.Thread(target=work, daemon=True) for _ in range(min(threads, len(items)))]
    for t in pool:
        t.start()
    for t in pool:
        t.join()
    return out


class RateLimited(Exception):
    """A provider's refusal; its message may tell the limit and when to ask again."""


class TooLong(Exception):
    """A provider's refusal of an input beyond the model's context."""


def told_limit(message: str) -> tuple[int | None, float | None]:
    """(tokens a minute, seconds to wait) of a refusal's message."""
    limit, wait = re.search(LIMIT_TOLD, message), re.search(WAIT_TOLD, message)
    return int(limit[1]) if limit else None, float(wait[1]) if wait else None


@dataclass
class Paced:
    """An embedder that keeps within a token budget, learns it from refusals, and shortens inputs that are too long.

    A refused request is sent again after the time that its message tells, the
    budget being what is left of the told limit after HEADROOM.  Of a request
    with an input that is too long each half is asked for itself, until that
    input is alone; then it is halved until it is taken or ``least_chars`` long.
    One is made in each task; a clock and a sleep may be given for tests.
    """

    inner: Embedder
    limit: int = 800_000
    least_chars: int = LEAST_CHARS
    retries: int = RETRIES
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep

    def __post_init__(self) -> None:
        self.dimension, self.max_chars = self.inner.dimension, self.inner.max_chars
        self.budget = TokenBudget(self.limit, self.clock, self.sleep)

    def embed(self, texts: list[str]) -> list[list[float]]:
        try:
            return self._asked(texts)
        except TooLong:
            if len(texts) > 1:
                half = len(texts) // 2
                return self.embed(texts[:half]) + self.embed(texts[half:])
            if not texts or len(texts[0]) <= self.least_chars:
                raise
            return self.embed([texts[0][: max(self.least_chars, len(texts[0]) // 2)]])

    def _asked(self, texts: list[str]) -> list[list[float]]:
        for attempt in range(self.retries + 1):
            self.budget.admit(sum(-(-len(t) // 2) for t in texts))
            try:
                return self.inner.embed(texts)
            except RateLimited as refused:
                if attempt == self.retries:
                    raise
                limit, wait = told_limit(str(refused))
                if limit:
                    self.budget.learn(limit)
                self.sleep(wait if wait is not None else WAIT_S)
        raise AssertionError


def embed(chunks: DataFrame, embedder: Embedder, text: str = "content", paced: Callable[[Embedder], Embedder] | None = None) -> DataFrame:
    """``chunks`` with embedding and dim; texts go to the embedder in request packs, each row keeps its vector.

    ``paced`` wraps the embedder once in each task, as ``Paced`` does: what it
    learns holds for all later requests of that task.
    """
    from pyspark.sql import functions as F

    names = chunks.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema) + ", embedding array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = paced(embedder) if paced else embedder
        for batch in batches:
            texts = [(t or "")[: embedder.max_chars] for t in batch.column(text).to_pylist()]
            vectors = [v for pack in request_packs(texts) for v in asked.embed(pack)]
            if len(vectors) != len(texts):
                raise ValueError("the embedder gave another number of vectors than texts")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*names, "embedding"])

    return chunks.mapInArrow(run, schema).withColumn("dim", F.lit(embedder.dimension))


def answer(prompts: DataFrame, model: Model, prompt: str = "prompt", threads: int = 1) -> DataFrame:
    """``prompts`` with text, tokens, outcome, error and duration_ms; one failed prompt is a failure row and stops no other.

    A task asks ``threads`` prompts at once; outcome is timeout for a call that
    ``with_timeout`` ended.
    """
    names = prompts.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema) + ", text string, prompt_tokens long, completion_tokens long, total_tokens long, outcome string, error string, duration_ms long"

    def ask(p: str | None) -> tuple:
        began = time.monotonic()
        try:
            r, error, outcome = model.generate(p or ""), None, "success"
        except Exception as e:  # a model's failure is data
            r, error, outcome = None, f"{type(e).__name__}: {e}", "timeout" if isinstance(e, TimeoutError) else "failure"
        known = r is not None and r.prompt_tokens is not None
        total = r.prompt_tokens + (r.completion_tokens or 0) if known else None
        return (r.text if r else None, r.prompt_tokens if r else None, r.completion_tokens if r else None, total, outcome, error, int(1000 * (time.monotonic() - began)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*each(ask, batch.column(prompt).to_pylist(), threads))) or [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=[*names, "text", "prompt_tokens", "completion_tokens", "total_tokens", "outcome", "error", "duration_ms"])

    return prompts.mapInArrow(run, schema)

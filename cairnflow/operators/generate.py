"""The generation stage: one prompt to many responses through a provider, in Arrow batches.

Generation costs money and isn't deterministic, so its output must be written before
anything reads it twice; :func:`write_once` does.  A failing prompt gives an error row and
leaves its siblings alone.
"""

from __future__ import annotations

import logging
import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stop_truncate

log = logging.getLogger(__name__)


@dataclass
class Sampling:
    temperature: float = 1.0
    top_p: float = 1.0
    top_k: int = -1
    min_p: float = 0.0
    repetition_penalty: float = 1.0
    max_tokens: int = 2048
    stop_sequences: list[str] = field(default_factory=list)
    seed: int | None = None
    n: int = 1


class ProviderError(Exception):
    """Not retried."""


class AuthError(ProviderError):
    """The key isn't accepted; not retried."""


class RetryableError(ProviderError):
    """Worth another try, after ``retry_after`` seconds if the server says so."""

    def __init__(self, message: str, retry_after: float = 0.0):
        super().__init__(message)
        self.retry_after = retry_after


class RateLimitError(RetryableError):
    pass


class ProviderTimeout(RetryableError):
    pass


class ConnectionFailed(RetryableError):
    pass


def error_of_status(status: int, text: str, retry_after: float = 0.0) -> ProviderError:
    """401 and 403 are final, 429 is retried, any other status is final."""
    if status in (401, 403):
        return AuthError(f"authentication failed: {text}")
    if status == 429:
        return RateLimitError(f"rate limit: {text}", retry_after)
    return ProviderError(f"HTTP {status}: {text}")


def retry(call: Callable, retries: int = 3, delay: float = 1.0, most: float = 60.0, factor: float = 2.0, jitter: bool = True, sleep: Callable[[float], None] = time.sleep):
    """``call()``, tried up to ``retries`` + 1 times.  A server's retry_after takes the delay's place and leaves the backoff where it is."""
    for attempt in range(retries + 1):
        try:
            return call()
        except RetryableError as e:
            if attempt == retries:
                raise
            if e.retry_after > 0:
                sleep(e.retry_after)
                continue
            sleep(min(most, delay) * (random.uniform(0.5, 1.5) if jitter else 1.0))
            delay *= factor


class Provider:
    """A backend.  ``open`` and ``close`` bracket a partition; ``generate`` gives one dict (text, token_count, finish_reason) or raises.

    A backend that has its own batches overrides ``generate_batch``.
    """

    name = "provider"
    model = ""

    def info(self) -> dict[str, str]:
        """What every response states of its origin."""
        return {"provider": self.name, "model": self.model}

    def open(self) -> None: ...

    def close(self) -> None: ...

    def generate(self, system: str, user: str, sampling: Sampling, sample_index: int) -> dict:
        raise NotImplementedError

    def generate_batch(self, tasks: list[tuple[str, str, int]], sampling: Sampling, concurrency: int) -> list[tuple[dict | Exception, float]]:
        """For each task (system, user, sample_index) its result, or what was raised, with its seconds; ``concurrency`` run at a time."""

        def one(task: tuple[str, str, int]) -> tuple[dict | Exception, float]:
            start = time.time()
            try:
                own = sampling if sampling.seed is None else replace(sampling, seed=sampling.seed + task[2])
                got: dict | Exception = self.generate(task[0], task[1], own, task[2])
            except Exception as e:  # noqa: BLE001  one prompt's failure is a row, not the task's
                got = e
            return got, time.time() - start

        with ThreadPoolExecutor(concurrency) as pool:
            return list(pool.map(one, tasks))


class MockProvider(Provider):
    """Answers with a number made of the prompt, the sampling and the sample's index: for tests and dry runs."""

    name = "mock"

    def generate(self, system: str, user: str, sampling: Sampling, sample_index: int) -> dict:
        n = int.from_bytes(sha256(f"{system}|{user}|{sampling.temperature}|{sampling.top_p}|{sampling.seed}|{sample_index}".encode()).digest()[:4], "big") % 1000
        text = f"<think>mock {sample_index}</think>\n<answer>{n}</answer>"
        return {"text": text, "token_count": len(text.split()), "finish_reason": "stop"}


class HTTPProvider(Provider):
    """A chat-completions API; the standard library's client, so executors need nothing more."""

    name = "http"

    def __init__(self, base_url: str, model: str, api_key: str = "", timeout: float = 120.0, retries: int = 3, delay: float = 1.0):
        self.base_url, self.model, self.api_key, self.timeout = base_url, model, api_key, timeout
        self.retries, self.delay = retries, delay

    def url(self) -> str:
        done = self.base_url.endswith(("/chat/completions", "/completions"))
        return self.base_url if done else self.base_url.rstrip("/") + "/chat/completions"

    def body(self, system: str, user: str, s: Sampling) -> dict:
        said = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": user}]
        out = {"model": self.model, "messages": said, "temperature": s.temperature, "top_p": s.top_p, "max_tokens": s.max_tokens, "n": 1}
        more = {"top_k": (s.top_k, s.top_k > 0), "min_p": (s.min_p, s.min_p > 0), "repetition_penalty": (s.repetition_penalty, s.repetition_penalty != 1), "stop": (s.stop_sequences, bool(s.stop_sequences)), "seed": (s.seed, s.seed is not None)}
        return out | {k: v for k, (v, wanted) in more.items() if wanted}

    def generate(self, system: str, user: str, sampling: Sampling, sample_index: int) -> dict:
        import json
        from urllib.error import HTTPError, URLError
        from urllib.request import Request, urlopen

        def post() -> dict:
            headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"}
            try:
                with urlopen(Request(self.url(), json.dumps(self.body(system, user, sampling)).encode(), headers), timeout=self.timeout) as r:
                    return json.load(r)
            except HTTPError as e:
                after = e.headers.get("retry-after", "")
                raise error_of_status(e.code, e.read().decode("utf-8", "replace"), float(after) if after.replace(".", "", 1).isdigit() else 0.0) from e
            except TimeoutError as e:
                raise ProviderTimeout(str(e)) from e
            except URLError as e:
                raise ConnectionFailed(str(e)) from e

        return read_response(retry(post, self.retries, self.delay))


def read_response(body: dict) -> dict:
    """text, token_count and finish_reason of an API response; no choices are an error, missing usage counts 0."""
    choices = body.get("choices") or []
    if not choices:
        raise ProviderError("the response has no choices")
    return {"text": choices[0].get("message", {}).get("content", ""), "token_count": body.get("usage", {}).get("completion_tokens", 0), "finish_reason": choices[0].get("finish_reason", "")}


SCHEMA = "prompt_id string, sample_index int, text string, token_count long, finish_reason string, latency_ms double, provider string, model string, temperature double, top_p double, seed long, error_class string, error string"


def answered(provider: Provider, members: list[tuple[str, str, str]], config: Sampling, concurrency: int = 8) -> list[tuple]:
    """Rows of SCHEMA for prompts (id, system, user) of one sampling, which go to the provider together."""
    chunk = [(i, s, u, n) for i, s, u in members for n in range(config.n)]
    results = provider.generate_batch([(s, u, n) for _, s, u, n in chunk], config, concurrency)
    said, out = provider.info(), []
    for (i, _, _, n), (r, seconds) in zip(chunk, results):
        got = (None, 0, None) if isinstance(r, Exception) else (r["text"], r["token_count"], r["finish_reason"])
        error = (type(r).__name__, f"{type(r).__name__}: {r}") if isinstance(r, Exception) else (None, None)
        out.append((i, n, *got, seconds * 1000, said["provider"], said["model"], config.temperature, config.top_p, config.seed, *error))
    return out


def cut_at_stops(text: str, stops: list[str]) -> str:
    """What :func:`..functions.text.stop_truncate` gives, in Python."""
    found = [at for s in stops if s and (at := text.find(s)) >= 0]
    return text[: min(found)].strip() if found else text


#: A table of responses: what :func:`run` gives.
RESPONSES = f"{SCHEMA}, response_id string"


def run(prompts: DataFrame, provider: Provider, sampling: Sampling, id_col: str = "id", concurrency: int = 8, batch_size: int = 16, progress: int = 0, run_id: str = "", profile=None) -> DataFrame:
    """One row for each prompt and sample, with an error and its class where the provider raised.

    Columns temperature, top_p and seed of the prompts take the place of ``sampling``'s (a null
    temperature or top_p doesn't, a null seed means none); rows of one sampling go to the
    provider together, ``batch_size`` prompts at a time.  Texts are cut at the sampling's stop
    sequences.  response_id is a hash of ``run_id``, the prompt's id and the sample's index.  A
    missing system_prompt counts as empty.  Samples of a seeded prompt are no copies of each
    other: sample k is asked for with seed + k, while the column seed states the prompt's own.
    With ``progress`` a worker logs every so many prompts.  ``profile`` is a ResourceProfile for
    the stage, such as a GPU for each task (:func:`.local_models.gpu_profile`).
    """
    given, there = asdict(sampling), set(prompts.columns)
    system = F.coalesce(F.col("system_prompt"), F.lit("")) if "system_prompt" in there else F.lit("")
    own = lambda name, kind: (F.col(name) if name in there else F.lit(given[name])).cast(kind)
    rows = prompts.select(
        F.col(id_col).cast("string").alias("id"), system.alias("system"), F.coalesce("user_prompt", F.lit("")).alias("user"),
        F.coalesce(own("temperature", "double"), F.lit(float(sampling.temperature))).alias("temperature"),
        F.coalesce(own("top_p", "double"), F.lit(float(sampling.top_p))).alias("top_p"), own("seed", "string").alias("seed"),
    )

    def work(batches: Iterator) -> Iterator:
        import pandas as pd

        done = 0
        provider.open()
        try:
            for b in batches:
                groups: dict[tuple, list[tuple[str, str, str]]] = {}
                for i, s, u, t, p, seed in zip(b["id"], b["system"], b["user"], b["temperature"], b["top_p"], b["seed"]):
                    groups.setdefault((t, p, None if seed is None or seed != seed else int(seed)), []).append((i, s, u))
                for (t, p, seed), members in groups.items():
                    config = replace(Sampling(**given), temperature=t, top_p=p, seed=seed)
                    for k in range(0, len(members), batch_size):
                        out = answered(provider, members[k : k + batch_size], config, concurrency)
                        frame = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
                        yield frame.astype({"seed": "Int64"})
                        if progress and (done + len(members[k : k + batch_size])) // progress > done // progress:
                            log.info("%d prompts done in this task", done + len(members[k : k + batch_size]))
                        done += len(members[k : k + batch_size])
        finally:
            provider.close()

    made = rows.mapInPandas(work, SCHEMA, profile=profile).withColumn("text", stop_truncate(F.col("text"), sampling.stop_sequences))
    of = [F.lit(run_id)] if run_id else []
    return made.withColumn("response_id", F.substring(F.sha2(F.concat_ws("#", *of, "prompt_id", "sample_index"), 256), 1, 32))


def write_once(generated: DataFrame, path: str) -> DataFrame:
    """Append to a Parquet table and read what is there: the barrier after a stage that must not run twice."""
    generated.write.mode("append").parquet(path)
    return generated.sparkSession.read.schema(generated.schema).parquet(path)


def batches(rows: DataFrame, key: list[str], *order: str, size: int = 16, salts: int = 64) -> DataFrame:
    """With ``batch``: slices of at most ``size`` rows of each key.

    Rows of a key are first dealt to ``salts`` shares and numbered in each, so a key that
    holds most of the rows isn't sorted in one task; a batch's number is share * 2**32 + slice.
    """
    share = F.pmod(F.xxhash64(*order), F.lit(salts))
    w = Window.partitionBy(*key, "__share").orderBy(*order)
    numbered = rows.withColumn("__share", share).withColumn("batch", F.col("__share") * (1 << 32) + F.floor((F.row_number().over(w) - 1) / size).cast("long"))
    return numbered.drop("__share")


def dealt(prompts: DataFrame, id_col: str = "id", size: int = 16, rows: int | None = None) -> DataFrame:
    """Prompts dealt to tasks so that a task's rows of one sampling lie together, in slices of ``size`` of :func:`batches`.

    Without sampling columns of their own they are dealt evenly.  ``rows`` says how many there
    are, which spares a count; a sampling that most rows have goes to many tasks.
    """
    n = prompts.count() if rows is None else rows
    tasks = max(1, min(-(-n // size), 4 * prompts.sparkSession.sparkContext.defaultParallelism))
    keys = [c for c in ("temperature", "top_p", "seed") if c in prompts.columns]
    if not keys:
        return prompts.repartition(tasks)
    sliced = batches(prompts, keys, id_col, size=size, salts=max(1, min(64, n // (8 * size))))
    return sliced.repartition(tasks, *keys, "batch").sortWithinPartitions(*keys, "batch").drop("batch")


def generation_config(temperature: Column, top_p: float = 1.0, top_k: int = 50, max_new_tokens: int = 512) -> Column:
    """Defaults merged with a temperature; zero means greedy, which has no sampling knobs."""
    greedy = temperature == 0
    return F.struct(
        (~greedy).alias("do_sample"),
        F.when(~greedy, temperature).alias("temperature"),
        F.when(~greedy, F.lit(top_p)).alias("top_p"),
        F.when(~greedy, F.lit(top_k)).alias("top_k"),
        F.lit(max_new_tokens).alias("max_new_tokens"),
    )

"""Providers that run a model in the worker, where the libraries are installed.  Each has batches of its own and runs one at a time."""

from __future__ import annotations

import time
from collections.abc import Callable

from .generate import Provider, ProviderError, Sampling


def chat(system: str, user: str) -> list[dict[str, str]]:
    return ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": user}]


def shared(results: list[dict], start: float) -> list[tuple[dict | Exception, float]]:
    """Each result with its share of the batch's time."""
    each = (time.time() - start) / max(1, len(results))
    return [(r, each) for r in results]


def gpu_profile(per_task: float = 1.0, per_executor: int | None = None, cores: int | None = None):
    """A ResourceProfile for a generation stage: ``per_task`` GPUs (a fraction is shared by as many tasks), and executors with that many or ``per_executor``.

        generate.run(prompts, VLLMProvider(model), sampling, profile=gpu_profile())

    It takes a cluster with dynamic allocation and spark.executor.resource.gpu.discoveryScript.
    """
    from pyspark.resource import ExecutorResourceRequests, ResourceProfileBuilder, TaskResourceRequests

    asks = ExecutorResourceRequests().resource("gpu", per_executor or max(1, round(per_task)))
    if cores:
        asks.cores(cores)
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(1).resource("gpu", per_task)).require(asks).build


#: This worker's engines by kind, model and options: a model is loaded once and serves all of the worker's tasks.
_engines: dict[str, object] = {}


def engine_of(kind: str, model: str, options: dict, load: Callable[[], object]):
    """The worker's engine; the last one makes way for another, as a GPU holds one."""
    key = f"{kind} {model} {sorted(options.items())!r}"
    if key not in _engines:
        _engines.clear()
        _engines[key] = load()
    return _engines[key]


class VLLMProvider(Provider):
    """A model in vLLM, loaded once by each worker; give such stages GPUs by :func:`gpu_profile`."""

    name = "vllm"

    def __init__(self, model: str, **options):
        self.model, self.options, self.engine = model, options, None

    def open(self) -> None:
        try:
            from vllm import LLM
        except ImportError as e:
            raise ProviderError("vllm isn't installed") from e
        self.engine = engine_of(self.name, self.model, self.options, lambda: LLM(model=self.model, **self.options))

    def close(self) -> None:
        self.engine = None

    def generate_batch(self, tasks: list[tuple[str, str, int]], sampling: Sampling, concurrency: int) -> list[tuple[dict | Exception, float]]:
        """The whole batch in one call of the engine; a failure is every task's."""
        from vllm import SamplingParams

        start = time.time()
        fixed = {"temperature": sampling.temperature, "top_p": sampling.top_p, "top_k": sampling.top_k, "min_p": sampling.min_p, "repetition_penalty": sampling.repetition_penalty, "max_tokens": sampling.max_tokens, "stop": sampling.stop_sequences or None}
        how = [SamplingParams(**fixed, seed=None if sampling.seed is None else sampling.seed + k) for _, _, k in tasks]
        try:
            outputs = [o.outputs[0] for o in self.engine.chat([chat(s, u) for s, u, _ in tasks], how)]
        except Exception as e:  # noqa: BLE001  the batch's failure is its rows', not the task's
            return shared([e] * len(tasks), start)
        return shared([{"text": o.text, "token_count": len(o.token_ids), "finish_reason": o.finish_reason or ""} for o in outputs], start)


class TransformersProvider(Provider):
    """A causal language model in transformers; greedy where the temperature is zero."""

    name = "transformers"

    def __init__(self, model: str):
        self.model, self.tool, self.net = model, None, None

    def open(self) -> None:
        try:
            from transformers import AutoModelForCausalLM, AutoTokenizer
        except ImportError as e:
            raise ProviderError("transformers isn't installed") from e
        self.tool, self.net = engine_of(self.name, self.model, {}, lambda: (AutoTokenizer.from_pretrained(self.model), AutoModelForCausalLM.from_pretrained(self.model)))

    def generate_batch(self, tasks: list[tuple[str, str, int]], sampling: Sampling, concurrency: int) -> list[tuple[dict | Exception, float]]:
        """One call of the model for the batch, its prompts padded on the left; a failure is every task's."""
        start = time.time()
        try:
            self.tool.padding_side = "left"
            if self.tool.pad_token is None:
                self.tool.pad_token = self.tool.eos_token
            texts = [self.tool.apply_chat_template(chat(s, u), add_generation_prompt=True, tokenize=False) for s, u, _ in tasks]
            given = self.tool(texts, return_tensors="pt", padding=True, add_special_tokens=False)
            greedy = sampling.temperature == 0
            knobs = {} if greedy else {"temperature": sampling.temperature, "top_p": sampling.top_p}
            if sampling.seed is not None:
                import torch

                torch.manual_seed(sampling.seed)
            made = self.net.generate(**given, do_sample=not greedy, max_new_tokens=sampling.max_tokens, **knobs)[:, given["input_ids"].shape[1] :]
            return shared([self.read(ids.tolist()) for ids in made], start)
        except Exception as e:  # noqa: BLE001  the batch's failure is its rows', not the task's
            return shared([e] * len(tasks), start)

    def read(self, ids: list[int]) -> dict:
        """A response's ids up to its end."""
        end = self.tool.eos_token_id
        ids, finish = (ids[: ids.index(end)], "stop") if end in ids else (ids, "length")
        return {"text": self.tool.decode(ids, skip_special_tokens=True), "token_count": len(ids), "finish_reason": finish}

"""Table functions in SQL: generation over a TABLE argument, and extraction of a response's parts.

    SELECT * FROM cairn_generate(TABLE(prompts), provider => 'mock', n => 2)
    SELECT r.id, p.* FROM responses r, LATERAL cairn_parts(r.text) p
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import StructType

from ..operators import generate

#: Prompts of a sampling that go to the provider together.
BATCH = 16
SETTINGS = ("temperature", "top_p", "top_k", "min_p", "repetition_penalty", "max_tokens", "seed", "n")


def generator(providers: dict[str, generate.Provider]) -> type:
    """The table function over these providers by name; they are sent to the workers with it."""

    schema = StructType.fromDDL(generate.RESPONSES)  # the workers can't read it

    class Generate:
        """One row for each prompt (id, user_prompt, and system_prompt, temperature, top_p and seed where there are any) and sample, as :func:`..operators.generate.run` gives them."""

        def __init__(self) -> None:
            self.held: dict[tuple, list[tuple[str, str, str]]] = {}
            self.provider: generate.Provider | None = None
            self.config = generate.Sampling()

        @staticmethod
        def analyze(prompts: AnalyzeArgument, provider: AnalyzeArgument | None = None, stop: AnalyzeArgument | None = None, **settings: AnalyzeArgument) -> AnalyzeResult:
            if not prompts.isTable:
                raise ValueError("the first argument is a TABLE of prompts")
            columns = {f.name for f in prompts.dataType.fields}
            if missing := {"id", "user_prompt"} - columns:
                raise ValueError(f"prompts need columns {sorted(missing)}")
            if unknown := set(settings) - set(SETTINGS):
                raise ValueError(f"no settings {sorted(unknown)}; there are {list(SETTINGS)}")
            if provider is not None and provider.value not in providers:
                raise ValueError(f"no provider {provider.value!r}; there are {sorted(providers)}")
            return AnalyzeResult(schema=schema)

        def eval(self, prompts, provider: str = "mock", stop: list[str] | None = None, **settings) -> Iterator[tuple]:
            if self.provider is None:
                self.provider, self.config = providers[provider], generate.Sampling(**settings, stop_sequences=list(stop or []))
                self.provider.open()
            given = prompts.asDict()
            own = lambda name: getattr(self.config, name) if given.get(name) is None else given[name]
            seed = given["seed"] if "seed" in given else self.config.seed
            key = (float(own("temperature")), float(own("top_p")), seed)
            members = self.held.setdefault(key, [])
            members.append((str(given["id"]), given.get("system_prompt") or "", given["user_prompt"] or ""))
            if len(members) == BATCH:
                yield from self.answered(key)

        def terminate(self) -> Iterator[tuple]:
            try:
                for key in list(self.held):
                    yield from self.answered(key)
            finally:
                if self.provider is not None:
                    self.provider.close()

        def answered(self, key: tuple) -> Iterator[tuple]:
            t, p, seed = key
            for row in generate.answered(self.provider, self.held.pop(key), generate.replace(self.config, temperature=t, top_p=p, seed=seed)):
                text = row[2] if row[2] is None else generate.cut_at_stops(row[2], self.config.stop_sequences)
                yield (*row[:2], text, *row[3:], sha256(f"{row[0]}#{row[1]}".encode()).hexdigest()[:32])

    return Generate


def register(spark: SparkSession, **providers: generate.Provider) -> list[str]:
    """Create the table functions in this session, with ``mock`` and the given providers; gives their names."""
    spark.udtf.register("cairn_generate", udtf(generator({"mock": generate.MockProvider()} | providers)))
    tag = lambda name: f"regexp_extract(x, r'(?s)<{name}>(.*?)</{name}>', 1)"
    stripped = "btrim({0}, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(28), chr(29), chr(30), chr(31), chr(133), chr(160)))"
    boxed = r"regexp_extract(x, r'\\boxed\{([^\n]*?)\}', 1)"
    answer = f"CASE WHEN x RLIKE r'(?s)<answer>.*?</answer>' THEN {stripped.format(tag('answer'))} WHEN x RLIKE r'\\\\boxed\\{{[^\\n]*?\\}}' THEN {stripped.format(boxed)} ELSE {stripped.format('x')} END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION cairn_parts(x STRING) RETURNS TABLE (thinking STRING, answer STRING) RETURN SELECT {stripped.format(tag('think'))}, {answer}")
    return ["cairn_generate", "cairn_parts"]

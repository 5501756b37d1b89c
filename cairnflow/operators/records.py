"""Task records: mappers of raw datasets, validation, first-wins dedup, ingestion report.

Raw records are VARIANT, which tells a JSON null from a missing key.  A mapper is registered
by dataset name and turns (ordinal, raw) rows into (ordinal, id, prompt,
ground_truth_answer, test_cases, metadata, reject); reject is null for good rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_whitespace, normalize_math, strip

Mapper = Callable[[DataFrame], DataFrame]
_mappers: dict[str, tuple[Mapper, str]] = {}


def register(name: str, task_type: str) -> Callable[[Mapper], Mapper]:
    """Register a mapper; a second one of a name takes its place."""

    def keep(mapper: Mapper) -> Mapper:
        _mappers[name] = (mapper, task_type)
        return mapper

    return keep


def mapper(name: str) -> tuple[Mapper, str]:
    if name not in _mappers:
        raise KeyError(f"no dataset {name!r}; there are {sorted(_mappers)}")
    return _mappers[name]


def has(raw: Column, key: str) -> Column:
    """Whether an object has the key, whatever its value: the path's parent lists it."""
    return F.coalesce(F.array_contains(F.map_keys(F.try_variant_get(raw, "$", "map<string,variant>")), key), F.lit(False))


def by_presence(raw: Column, *keys: str) -> Column:
    """The string of the first key that is there; null if its value isn't a string; empty without any of them."""
    out = F.lit("")
    for k in reversed(keys):
        out = F.when(has(raw, k), text_of(raw, k)).otherwise(out)
    return out


def text_of(raw: Column, key: str) -> Column:
    """The value of a key if it is a string, else null."""
    value = F.try_variant_get(raw, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(raw, f"$.{key}", "string"))


def falsy(raw: Column, key: str) -> Column:
    """Whether the key has 0 or false, which load validation takes for no id."""
    value, kind = F.try_variant_get(raw, f"$.{key}", "string"), F.schema_of_variant(F.try_variant_get(raw, f"$.{key}", "variant"))
    return F.coalesce((kind != "STRING") & ((value == "false") | (value.try_cast("double") == 0)), F.lit(False))


def gsm8k_final(answer: Column) -> Column:
    """What stands after the last ``####``, else the whole; stripped."""
    return strip(F.element_at(F.split(answer, "####"), -1))


@register("gsm8k", "math")
def gsm8k(rows: DataFrame) -> DataFrame:
    raw = F.col("raw")
    answer = strip(by_presence(raw, "answer", "ground_truth"))
    given = F.when(has(raw, "id"), F.try_variant_get(raw, "$.id", "string")).otherwise(F.concat(F.lit("gsm8k-"), F.col("ordinal").cast("string")))
    return rows.select(
        "ordinal",
        given.alias("id"),
        strip(by_presence(raw, "question", "prompt")).alias("prompt"),
        gsm8k_final(answer).alias("ground_truth_answer"),
        F.lit(None).cast("array<map<string,string>>").alias("test_cases"),
        F.create_map(F.lit("full_answer_steps"), answer, F.lit("index"), F.col("ordinal").cast("string"), F.lit("dataset"), F.lit("gsm8k")).alias("metadata"),
        falsy(raw, "id").alias("no_id"),
    ).transform(rejected)


@register("mbpp", "code")
def mbpp(rows: DataFrame) -> DataFrame:
    raw = F.col("raw")
    listed = F.when(has(raw, "test_list"), F.try_variant_get(raw, "$.test_list", "array<variant>")).otherwise(F.try_variant_get(raw, "$.test_cases", "array<variant>"))
    given = F.lit(None).cast("string")
    for key, default in (("task_id", F.concat(F.lit("mbpp-"), F.col("ordinal").cast("string"))), ("id", None)):
        given = F.when(has(raw, key), F.try_variant_get(raw, f"$.{key}", "string")).otherwise(given if default is None else default)
    return rows.select(
        "ordinal",
        given.alias("id"),
        strip(by_presence(raw, "text", "prompt")).alias("prompt"),
        strip(by_presence(raw, "code", "ground_truth")).alias("ground_truth_answer"),
        test_cases(F.coalesce(listed, F.array().cast("array<variant>"))).alias("test_cases"),
        F.create_map(F.lit("index"), F.col("ordinal").cast("string"), F.lit("dataset"), F.lit("mbpp")).alias("metadata"),
        F.when(has(raw, "id"), falsy(raw, "id")).otherwise(falsy(raw, "task_id")).alias("no_id"),
    ).transform(rejected)


def test_cases(listed: Column) -> Column:
    """array<map<string,string>>: strings become {assertion: …}, objects stay, anything else is dropped."""
    kind = lambda v: F.schema_of_variant(v)
    kept = F.filter(listed, lambda v: (kind(v) == "STRING") | kind(v).startswith("OBJECT"))
    return F.transform(kept, lambda v: F.when(kind(v) == "STRING", F.create_map(F.lit("assertion"), F.try_variant_get(v, "$", "string"))).otherwise(F.try_variant_get(v, "$", "map<string,string>")))


def rejected(entries: DataFrame) -> DataFrame:
    """With ``reject``: malformed where a mapper couldn't read a value, empty where id, prompt or answer is empty, or ``no_id`` says so of the id."""
    values = ("id", "prompt", "ground_truth_answer")
    unread = F.lit(False)
    empty = F.col("no_id") if "no_id" in entries.columns else F.lit(False)
    for c in values:
        unread = unread | F.col(c).isNull()
        empty = empty | (F.col(c) == "")
    return entries.withColumn("reject", F.when(unread, "malformed").when(empty, "empty")).drop("no_id")


def valid(entries: DataFrame) -> DataFrame:
    """Rows whose id and prompt aren't blank and whose answer isn't null (it may be empty)."""
    return entries.where((strip(F.col("id")) != "") & (strip(F.col("prompt")) != "") & F.col("ground_truth_answer").isNotNull())


def dedup_first(entries: DataFrame, key: str = "id", order: str = "ordinal") -> DataFrame:
    """The row with the smallest ``order`` of each ``key``.

    A minimum of structs rather than a window: partial aggregates leave one row of a hot key
    in each task before anything is dealt.
    """
    rest = [c for c in entries.columns if c != order]
    kept = entries.groupBy(F.col(key).alias("__key")).agg(F.min_by(F.struct(*entries.columns), F.col(order)).alias("r"))
    return kept.select(*(F.col("r")[c].alias(c) for c in [order, *rest])).select(*entries.columns)


def load(rows: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """(entries, report) of raw (ordinal, raw) rows: mapped, rejects dropped, first of each id kept.

    The report has n_raw, n_loaded, n_malformed and n_duplicates; rows that can't be parsed
    (null raw) count as malformed.
    """
    mapped = mapper(dataset)[0](rows)
    kept = dedup_first(mapped.where("reject is null").drop("reject"))
    return kept, ingest_report(mapped)


def ingest_report(mapped: DataFrame) -> DataFrame:
    """Counts by what happened to rows with columns id and reject."""
    good = F.col("reject").isNull()
    return mapped.agg(
        F.count("*").alias("n_raw"),
        F.count_distinct(F.when(good, F.col("id"))).alias("n_loaded"),
        F.count_if(~good).alias("n_malformed"),
        (F.count_if(good) - F.count_distinct(F.when(good, F.col("id")))).alias("n_duplicates"),
    )


def ingest(entries: DataFrame, math: bool = True) -> DataFrame:
    """Validate, keep the first of each id, and clean prompt and answer of what is left; normalise math if asked."""
    tidy = (lambda c: normalize_math(clean_whitespace(c))) if math else clean_whitespace
    return dedup_first(valid(entries)).withColumns({"prompt": clean_whitespace(F.col("prompt")), "ground_truth_answer": tidy(F.col("ground_truth_answer"))})


def with_ordinal(rows: DataFrame, order: str) -> DataFrame:
    """ordinal from 0 in the order of a column: a range-partitioned sort, written down so that its partitions stay, and their counts."""
    from ..session import checkpointed
    from ..sources.readers import indexed

    return indexed(checkpointed(rows.orderBy(order)))

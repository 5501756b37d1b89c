"""The query catalogue on the test tables: each takes (spark, sf_dir); :mod:`.oracles` has the same in SQL."""

from __future__ import annotations

from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import tables
from ..functions import text as T
from ..operators import aggregates, generate, prompts, records, trajectories, verifiers
from ..session import checkpoint_dir, checkpointed, removed
from ..sources import committed, hub, readers
from . import grids, runner

#: Response texts made of an order's keys, every extractor branch; valid in Spark's and DuckDB's SQL alike.
RESPONSE = """CASE o_orderkey % 12
WHEN 0 THEN '<think>sum ' || CAST(o_orderkey AS STRING) || '</think>' || chr(10) || '<answer> ' || CAST(o_custkey AS STRING) || ' </answer>'
WHEN 1 THEN '<THINK>Mixed</Think> then <Answer>' || CAST(o_orderkey AS STRING) || '</ANSWER>'
WHEN 2 THEN '<think>a</think><answer></answer> total ' || CAST(o_orderkey AS STRING) || '.5'
WHEN 3 THEN 'The value is ' || chr(92) || 'boxed{' || CAST(o_custkey AS STRING) || '}.'
WHEN 4 THEN chr(92) || 'boxed{' || chr(92) || 'frac{' || CAST(o_orderkey AS STRING) || '}{2}} done'
WHEN 5 THEN chr(92) || 'boxed{un{bal ' || chr(92) || 'boxed{ok}'
WHEN 6 THEN '<think>t</think>' || chr(10) || 'final total is -' || CAST(o_orderkey AS STRING) || '.25'
WHEN 7 THEN 'Calculating' || chr(13) || chr(10) || chr(9) || 'no digits   here' || chr(10) || '  '
WHEN 8 THEN '<think>cut</think> <answer>' || CAST(o_custkey AS STRING)
WHEN 9 THEN '$' || CAST(o_orderkey AS STRING) || ' ' || chr(92) || '( x ' || chr(92) || ') 50' || chr(92) || '%'
WHEN 10 THEN CAST(o_custkey AS STRING)
ELSE 'ratio 3/4 of $1,000' END"""

#: Code texts, every branch of the code extractor and some unsafe code.
CODE = """CASE o_orderkey % 6
WHEN 0 THEN 'x' || chr(10) || '```python' || chr(10) || 'def f(): return ' || CAST(o_custkey AS STRING) || chr(10) || '```'
WHEN 1 THEN '```py' || chr(10) || 'import  os' || chr(10) || '```'
WHEN 2 THEN '<answer>eval(1)</answer>'
WHEN 3 THEN ' print(open(1)) '
WHEN 4 THEN '```' || chr(10) || 'from sys import argv; exec(2)' || chr(10) || '``` and <answer>no</answer>'
ELSE 'return ' || CAST(o_orderkey AS STRING) END"""

RECIPE = grids.Recipe(personas=["analytical", "teacher"], strategies=["default"], styles=["standard"], query_rewrites=["standard", "elegant"], temperatures=[0.5, 1.0], top_p=[0.95], seeds=[None, 7], samples_per_configuration=2)
PERSONAS = {"analytical": "Work with rigor.", "teacher": "Explain every step."}
STYLES = {"standard": "Use the tags <think> and <answer>."}
SUMS = ("You check sums.", "Is this right?\n")
STOPS = ["</answer>", "total", "done"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.expr(RESPONSE).alias("text"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(CODE).alias("text"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as responses: source is the persona, quality the verdict where there is a label."""
    d, label = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(label, "doc_id", "left").select("doc_id", F.col("source").alias("persona"), (F.col("quality") == 1).alias("is_correct"), F.col("n_chars").alias("token_count"), "text")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as prompts: their urls."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), F.lit("Be brief.").alias("system_prompt"), F.col("url").alias("user_prompt"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("user_prompt"))


# -- text and extraction ------------------------------------------------------------------


def clean_whitespace(spark, d):
    spaced = F.concat(F.lit("\t "), F.replace("text", F.lit(". "), F.lit(" \r\n\r   ")), F.lit("\n\n"))
    return table(spark, d, "documents").select("doc_id", T.clean_whitespace(spaced).alias("cleaned"))


def normalize_math(spark, d):
    return responses(spark, d).select("o_orderkey", T.normalize_math(F.col("text")).alias("normalized"))


def last_number(spark, d):
    return table(spark, d, "documents").select("doc_id", A.last_number(F.col("text")).alias("number"))


def parse_response(spark, d):
    return responses(spark, d).select("o_orderkey", *(c.alias(k) for k, c in A.parse_response(F.col("text")).items()))


def extract_math_answer(spark, d):
    return responses(spark, d).select("o_orderkey", A.math_answer(F.col("text")).alias("answer"))


def provider_answer(spark, d):
    return responses(spark, d).select("o_orderkey", A.provider_thinking(F.col("text")).alias("thinking"), A.provider_answer(F.col("text")).alias("answer"))


def parse_vs_verify(spark, d):
    x = F.col("text")
    both = responses(spark, d).select((F.col("o_orderkey") % 12).alias("template"), (A.parse_response(x)["answer"] != A.math_answer(x)).alias("differs"))
    return both.groupBy("template").agg(F.count("*").alias("n"), F.count_if("differs").alias("n_differs"))


def extract_code(spark, d):
    return codes(spark, d).select("o_orderkey", A.code(F.col("text")).alias("code"))


def unsafe_code(spark, d):
    return codes(spark, d).select("o_orderkey", A.unsafe_pattern(A.code(F.col("text"))).alias("pattern"))


def code_static(spark, d):
    c = codes(spark, d).select(A.code(F.col("text")).alias("code"))
    return c.groupBy(A.unsafe_pattern(F.col("code")).alias("pattern")).agg(F.count("*").alias("n"))


def verify_math(spark, d):
    v = A.math_verdict(F.col("text"), F.col("o_custkey").cast("string"))
    return responses(spark, d).select("o_orderkey", *(c.alias(k) for k, c in v.items()))


def verify_typed(spark, d):
    """The verdict by each row's task type: maths, code unless it must be run, and a type without a verifier."""
    kinds = F.element_at(F.array(*map(F.lit, ["math", "code", "essay"])), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", kinds.alias("task_type"), F.when(kinds == "code", F.expr(CODE)).otherwise(F.expr(RESPONSE)).alias("text"), F.col("o_custkey").cast("string").alias("ground_truth_answer"))
    out = verifiers.verify(rows, F.col("task_type"))
    return out.select("o_orderkey", "task_type", "is_correct", "verify_error")


def stop_truncate(spark, d):
    return responses(spark, d).select("o_orderkey", T.stop_truncate(F.col("text"), STOPS).alias("cut"))


def gen_config(spark, d):
    merged = generate.generation_config(F.when(F.col("o_orderkey") % 3 == 0, 0.0).otherwise((F.col("o_orderkey") % 5 + 1) / 5))
    return responses(spark, d).select("o_orderkey", *(merged[k].alias(k) for k in ("do_sample", "temperature", "top_p", "max_new_tokens")), merged["top_k"].cast("double").alias("top_k"))


# -- records ------------------------------------------------------------------------------


def gsm8k_answer(spark, d):
    raw = F.parse_json(F.to_json(F.struct(F.col("text").alias("question"), F.concat(F.lit("a #### b #### "), F.col("o_custkey").cast("string")).alias("answer"))))
    rows = responses(spark, d).select(F.col("o_orderkey").alias("ordinal"), raw.alias("raw"))
    return records.gsm8k(rows).select("ordinal", "id", "prompt", "ground_truth_answer", "reject")


def mbpp_tests(spark, d):
    listed = F.concat(F.lit('{"task_id": '), F.col("o_orderkey").cast("string"), F.lit(', "text": "t", "code": "c", "test_list": ["assert f() == '), F.col("o_custkey").cast("string"), F.lit('", {"assertion": "b"}, 5]}'))
    rows = responses(spark, d).select(F.col("o_orderkey").alias("ordinal"), F.parse_json(listed).alias("raw"))
    out = records.mbpp(rows)
    return out.select("ordinal", "id", F.size("test_cases").alias("n_tests"), F.col("test_cases")[0]["assertion"].alias("first_test"), F.col("test_cases")[1]["assertion"].alias("second_test"))


def entries(spark, d):
    """Documents as entries keyed by their text, so that copies share an id."""
    t = F.col("text")
    return table(spark, d, "documents").select(F.md5(t).alias("id"), t.alias("prompt"), F.when(F.col("doc_id") % 7 == 0, F.lit("")).when(F.col("doc_id") % 11 != 0, F.col("lang")).alias("ground_truth_answer"), F.col("doc_id").alias("ordinal"))


def validate_entries(spark, d):
    return records.valid(entries(spark, d)).select("ordinal", "id", "ground_truth_answer")


def dedup_first(spark, d):
    return records.dedup_first(entries(spark, d)).select("id", "ordinal")


def ingest_pipeline(spark, d):
    return records.ingest(entries(spark, d)).select("id", "ordinal", "prompt", "ground_truth_answer")


def ingest_report(spark, d):
    return records.ingest_report(records.rejected(entries(spark, d)))


def json_props(spark, d):
    e = table(spark, d, "events").select("event_type", F.try_variant_get(F.parse_json("props"), "$.k", "long").alias("k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("sum_k"), F.max("k").alias("max_k"))


def with_ordinal(spark, d):
    return records.with_ordinal(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", "ordinal")


def load_falsy(spark, d):
    """Raw records with ids 0, 1 and 2: 0 is no id."""
    raw = F.parse_json(F.to_json(F.struct(F.col("text").alias("question"), F.lit("so #### 5").alias("answer"), (F.col("item_id") % 3).alias("id"))))
    return records.load(table(spark, d, "benchmark").select(F.col("item_id").alias("ordinal"), raw.alias("raw")), "gsm8k")[1]


def record_metadata(spark, d):
    raw = F.parse_json(F.to_json(F.struct(F.col("text").alias("question"), F.concat(F.lit(" steps #### "), F.col("item_id").cast("string"), F.lit(" ")).alias("answer"))))
    m = F.col("metadata")
    return records.gsm8k(table(spark, d, "benchmark").select(F.col("item_id").alias("ordinal"), raw.alias("raw"))).select("id", "ground_truth_answer", m["full_answer_steps"].alias("steps"), m["index"].alias("index"), m["dataset"].alias("dataset"))


def folder_for(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid4().hex}"


def kept(rows: DataFrame, folder: str) -> DataFrame:
    """The rows, which were read from a folder that is then removed."""
    out = checkpointed(rows)
    removed(rows.sparkSession, folder)
    return out


def item_file(spark, d, name: str, whole: bool):
    """Benchmark items written as JSON lines, with blank and broken ones between, or as one JSON list; the folder."""
    folder = folder_for(spark, name)
    item = F.to_json(F.struct(F.col("item_id").alias("id"), F.col("text").alias("problem")))
    b = table(spark, d, "benchmark")
    if whole:  # a list is one file by nature
        rows = b.select("item_id", F.concat(item, F.lit(",")).alias("value"))
        ends = spark.createDataFrame([(-1, "["), (1 << 60, '{"id": -1}]')], "item_id long, value string")
        rows.union(ends).orderBy("item_id").coalesce(1).select("value").write.text(folder)
    else:
        value = F.when(F.col("item_id") % 7 == 3, "{bad").when(F.col("item_id") % 5 == 2, "  ").otherwise(item)
        b.orderBy("item_id").select(value.alias("value")).write.text(folder)
    return folder


def scan_json(spark, d):
    folder = item_file(spark, d, "list", True)
    return kept(readers.scan_json(spark, folder).select("ordinal", F.try_variant_get("raw", "$.id", "long").alias("item_id"), F.try_variant_get("raw", "$.problem", "string").alias("problem")), folder)


def scan_jsonl(spark, d):
    folder = item_file(spark, d, "lines", False)
    return kept(readers.scan_jsonl(spark, folder).select("ordinal", F.try_variant_get("raw", "$.id", "long").alias("item_id"), F.try_variant_get("raw", "$.problem", "string").alias("problem")), folder)


def scan_prompts(spark, d):
    folder = item_file(spark, d, "prompts", False)
    return kept(readers.scan_prompts(spark, folder, "Be brief.").select("id", "system_prompt", "user_prompt"), folder)


def scan_prompt_list(spark, d):
    """Pages in files of one JSON list each: an id that is 0 gives way to the place among all."""
    folder = folder_for(spark, "prompt-list")

    def as_list(batches):
        yield pa.RecordBatch.from_pydict({"value": ["["]})
        comma = ""
        for b in batches:
            rows = b.column(0).to_pylist()
            if rows:
                yield pa.RecordBatch.from_pydict({"value": [comma + ",".join(rows)]})
                comma = ","
        yield pa.RecordBatch.from_pydict({"value": ["]"]})

    item = F.to_json(F.struct(F.col("page_id").alias("id"), F.col("url").alias("problem")))
    table(spark, d, "pages").repartitionByRange("page_id").sortWithinPartitions("page_id").select(item.alias("value")).mapInArrow(as_list, "value string").write.text(folder)
    return kept(readers.scan_prompts(spark, folder).select("id", "user_prompt"), folder)


def scan_rejects(spark, d):
    folder = item_file(spark, d, "rejects", False)
    return kept(readers.rejects(spark, folder), folder)


def scan_hub(spark, d):
    """Documents as a dataset in many files, read by row groups."""
    folder = folder_for(spark, "hub")
    table(spark, d, "documents").orderBy("doc_id").select("doc_id", "lang", F.length("text").alias("size")).write.option("maxRecordsPerFile", 150).parquet(f"{folder}/train")
    out = hub.scan_hub(spark, folder)
    return kept(out.select("ordinal", F.try_variant_get("raw", "$.doc_id", "long").alias("doc_id"), F.try_variant_get("raw", "$.lang", "string").alias("lang"), F.try_variant_get("raw", "$.size", "long").alias("size")), folder)


def sink_committed(spark, d):
    """Documents in three commits, one of which is played again."""
    folder = folder_for(spark, "committed")
    rows = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    for part in (0, 1, 1, 2):
        committed.append(rows.where(F.pmod("doc_id", F.lit(3)) == part), folder, f"part-{part}")
    return kept(committed.read(spark, folder), folder)


# -- prompts and grids --------------------------------------------------------------------


def chatml_prompt(spark, d):
    return prompts.build_chat(questions(spark, d), "Solve math problems.", "Problem: {prompt}", "user_prompt").drop("user_prompt")


def template_render(spark, d):
    rows = questions(spark, d).withColumnRenamed("user_prompt", "problem")
    prompts.register_template("sums", SUMS[0], SUMS[1] + "{problem}")
    return prompts.render(rows, "sums").drop("problem")


def jobs(spark, d):
    return grids.jobs(questions(spark, d), RECIPE)


def query_rewrite(spark, d):
    named = F.element_at(F.array(*map(F.lit, ["standard", "default", "", "beginner", "elegant", "alternative_method", "unknown"])), (F.col("id").cast("int") % 7 + 1))
    rows = questions(spark, d).select("id", F.col("user_prompt").alias("raw_user_prompt"), named.alias("rewrite"))
    return prompts.rewrite(rows).select("id", "rewrite", "user_prompt")


def compose_prompts(spark, d):
    dim = lambda texts, name: prompts.dimension(spark, texts, name)
    out = prompts.compose(jobs(spark, d), dim({"analytical": PERSONAS["analytical"]}, "persona"), spark.createDataFrame([], "strategy string, strategy_text string"), dim(STYLES, "style"))
    return out.select("job_id", "system_prompt", "user_prompt")


def chat_messages(spark, d):
    system = F.when(F.col("id").cast("int") % 2 == 0, "Be brief.").otherwise("")
    m = questions(spark, d).select("id", prompts.messages(system, F.col("user_prompt")).alias("m"))
    return m.select("id", F.size("m").alias("n"), F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), F.element_at("m", -1)["content"].alias("last"))


def sampling_struct(seed):
    given = {"temperature": F.lit(0.7), "top_p": F.lit(0.9), "top_k": F.lit(-1), "min_p": F.lit(0.1), "repetition_penalty": F.lit(1.0), "max_tokens": F.lit(2048), "stop_sequences": F.array(F.lit("</answer>")), "seed": seed}
    return F.struct(*(c.alias(k) for k, c in given.items()))


def api_payload(spark, d):
    seed = F.when(F.col("id").cast("int") % 3 == 0, F.lit(None).cast("long")).otherwise(F.col("id").cast("long"))
    p = prompts.payload(F.lit("m1"), prompts.messages(F.lit(""), F.col("user_prompt")), sampling_struct(seed))
    text = questions(spark, d).select("id", F.to_json(p).alias("j"))
    get = lambda path: F.get_json_object("j", path)
    return text.select("id", get("$.model").alias("model"), get("$.n").alias("n"), get("$.top_k").alias("top_k"), get("$.min_p").alias("min_p"), get("$.repetition_penalty").alias("repetition_penalty"), get("$.stop[0]").alias("stop"), get("$.seed").alias("seed"), get("$.messages[0].role").alias("role"))


def endpoint_url(spark, d):
    shaped = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("/v1/completions"))).when(F.col("page_id") % 3 == 1, F.concat("url", F.lit("//"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", prompts.endpoint(shaped).alias("endpoint"))


def grid_defaults(spark, d):
    """A recipe with but one axis: the others have their defaults."""
    out = grids.jobs(questions(spark, d), grids.Recipe(personas=["teacher"]))
    return out.select("job_id", "persona", "strategy", "style", "rewrite", "temperature", "top_p", "sample_index")


def sampling_applied(spark, d):
    """Responses by the sampling that they were generated with: their job's own."""
    made = generate.run(jobs(spark, d).withColumnRenamed("job_id", "id").withColumnRenamed("raw_user_prompt", "user_prompt"), generate.MockProvider(), generate.Sampling(n=2, temperature=9.0))
    return made.groupBy("temperature", "top_p", seed_text()).agg(F.count("*").alias("n"), F.count_distinct("response_id").alias("n_ids"))


def seed_text():
    return F.coalesce(F.col("seed").cast("string"), F.lit("None")).alias("seed")


def grid_jobs(spark, d):
    return jobs(spark, d).select("job_id", "prompt_id", "persona", "strategy", "style", "rewrite", "temperature", "top_p", seed_text(), "sample_index", "combo")


def experiment_prompts(spark, d):
    return grids.experiment(questions(spark, d), PERSONAS, STYLES, [0.5, 1.0], [None, 7]).select("id", "base_prompt_id", "system_prompt", "temperature", seed_text(), "combo")


def sampling_groups(spark, d):
    return grids.sampling_groups(jobs(spark, d)).select("temperature", "top_p", seed_text(), "n_jobs", "n_batches")


def batch_assign(spark, d):
    return generate.batches(jobs(spark, d), ["temperature", "top_p", "seed"], "prompt_id", "combo", size=16, salts=1).groupBy("temperature", "top_p", seed_text(), "batch").agg(F.count("*").alias("n"))


def resume_union(spark, d):
    lab, bench = table(spark, d, "labels"), table(spark, d, "benchmark")
    return trajectories.completed_ids(lab.select(F.col("doc_id").alias("id")), bench.select(F.col("item_id").alias("id")))


def resume_anti(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    return trajectories.pending(docs, resume_union(spark, d))


def job_outcome_join(spark, d):
    j = jobs(spark, d)
    outcomes = j.select("job_id", F.length("raw_user_prompt").alias("n_tokens")).where("sample_index = 0")
    return j.join(outcomes, "job_id", "left").groupBy("persona").agg(F.count("*").alias("n_jobs"), F.count("n_tokens").alias("n_done"), F.sum("n_tokens").alias("n_tokens"))


def batch_dispatch(spark, d):
    """The shipped way, with shares: every job is in one slice of its sampling, and no slice is over its size."""
    keys = ["temperature", "top_p", "seed"]
    sliced = generate.batches(grids.jobs(asked(spark, d), RECIPE), keys, "prompt_id", "combo", size=16).groupBy(*keys, "batch").agg(F.count("*").alias("n"))
    return sliced.groupBy("temperature", "top_p", seed_text()).agg(F.sum("n").alias("n_jobs"), (F.max("n") <= 16).alias("within_size"))


def run_resumed(spark, d):
    """Responses of a run that had half of its prompts when it stopped."""
    folder, config = folder_for(spark, "resumed"), generate.Sampling(n=2, seed=5)
    half = asked(spark, d).where(F.col("id").cast("long") % 2 == 0)
    runner.generate_pending(half, generate.MockProvider(), config, runner.Run.opened(spark, folder), every=2000)
    out = runner.generate_pending(asked(spark, d), generate.MockProvider(), config, runner.Run.opened(spark, folder), every=2000)
    return kept(out.select("prompt_id", "sample_index", "text"), folder)


def run_fresh(spark, d):
    """Spectra of a second run without resume, in the folder of a first."""
    folder, config = folder_for(spark, "fresh"), generate.Sampling(n=3)
    source = asked(spark, d)
    truths = source.select(F.col("id").alias("prompt_id"), F.lit("7").alias("ground_truth_answer"))
    for resume in (True, False):
        out = runner.run_prompts(source, truths, generate.MockProvider(), config, folder, resume=resume, every=2000)
    total = F.aggregate("responses", F.lit(0).cast("long"), lambda s, r: s + r["token_count"])
    return kept(out["spectra"].select("prompt_id", "n_responses", F.col("metadata.total_candidates").alias("total"), total.alias("tokens")), folder)


def run_report(spark, d):
    status = F.when(F.col("combo") % 5 == 0, "failed").when(F.col("combo") % 7 == 0, "skipped").otherwise("completed")
    done = F.col("status") == "completed"
    rows = jobs(spark, d).select(status.alias("status"), F.length("raw_user_prompt").alias("n"))
    return trajectories.run_report(rows.select("status", F.when(done, 2).otherwise(0).alias("n_responses"), F.when(done, F.col("n")).otherwise(0).alias("n_tokens"), F.lit(0.25).alias("elapsed")))


def generate_mock(spark, d):
    config = generate.Sampling(n=2, seed=11)
    return generate.run(questions(spark, d), generate.MockProvider(), config).select("prompt_id", "sample_index", "text", "token_count", "finish_reason", "error")


def generate_sql(spark, d):
    """Generation by a table function in SQL, over pages."""
    tables.register(spark)
    # a view of the query's own name, as queries may run side by side
    asked(spark, d).drop("system_prompt").createOrReplaceTempView("cairn_generate_sql")
    return spark.sql("SELECT prompt_id, sample_index, text, token_count, finish_reason, error FROM cairn_generate(TABLE(cairn_generate_sql), provider => 'mock', n => 2, seed => 11)")


def answer_parts(spark, d):
    """The provider's thinking and answer by a table function in SQL, of texts made of urls."""
    tables.register(spark)
    kind, url = F.col("page_id") % 4, F.coalesce("url", F.lit(""))
    made = F.when(kind == 0, F.concat(F.lit("<think> "), url, F.lit("</think> <answer>\n"), url, F.lit(" </answer>"))).when(kind == 1, F.concat(F.lit("so \\boxed{"), url, F.lit("}."))).when(kind == 2, F.concat(F.lit("<think>cut <answer>"), url)).otherwise(url)
    table(spark, d, "pages").select("page_id", made.alias("text")).createOrReplaceTempView("cairn_answer_parts")
    return spark.sql("SELECT r.page_id, p.thinking, p.answer FROM cairn_answer_parts r, LATERAL cairn_parts(r.text) p")


# -- aggregates ---------------------------------------------------------------------------


def turns(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", "text", F.substring("text", 1, 3).alias("extracted_answer"), F.when(F.col("turn") % 3 == 0, 0).otherwise(F.length("text")).alias("token_count"))


def pairwise_jaccard(spark, d):
    out = trajectories.pairwise_jaccard(turns(spark, d), "conv_id", "turn")
    return out.select("conv_id", "n_texts", F.round("avg_jaccard", 9).alias("avg_jaccard"))


def diversity_stats(spark, d):
    out = trajectories.diversity(turns(spark, d), "conv_id", "turn")
    return out.select("conv_id", "total_responses", "unique_texts", "unique_answers", "duplicates", F.round("avg_chars", 6).alias("avg_chars"), "min_chars", "max_chars", F.round("avg_tokens", 6).alias("avg_tokens"), "min_tokens", "max_tokens")


def diversity_score(spark, d):
    out = trajectories.diversity(turns(spark, d), "conv_id", "turn")
    return out.select("conv_id", F.round("diversity_score", 9).alias("diversity_score"), F.round("avg_semantic", 9).alias("avg_semantic"))


def semantic_diversity(spark, d):
    out = trajectories.semantic_similarity(table(spark, d, "embeddings"), "label")
    return out.select("label", "n_vectors", F.round("avg_cosine", 9).alias("avg_cosine"))


def cosine_plugin(spark, d):
    out = aggregates.aggregated(table(spark, d, "embeddings"), "label", "mean_cosine")
    return out.select("label", "n_vectors", F.round("avg_cosine", 9).alias("avg_cosine"))


def diversity_plugin(spark, d):
    out = aggregates.lexical(turns(spark, d), "conv_id")
    return out.select("conv_id", "total_responses", "unique_texts", "unique_answers", "duplicates", F.round("avg_chars", 6).alias("avg_chars"), "min_chars", "max_chars", F.round("avg_tokens", 6).alias("avg_tokens"), "min_tokens", "max_tokens")


def correctness_stats(spark, d):
    return trajectories.correctness(judged(spark, d), "persona").withColumn("ratio", F.round("ratio", 9))


def leaderboard(spark, d):
    return trajectories.leaderboard(judged(spark, d), order="doc_id")


def recipe_summary(spark, d):
    return trajectories.recipe_summary(judged(spark, d), trajectories.diversity(turns(spark, d), "conv_id", "turn"), "persona")


def spectrum_nested(spark, d):
    out = trajectories.spectra(turns(spark, d), "conv_id", "turn", ["text", "token_count"])
    return out.select("conv_id", "n_responses", F.element_at("responses", 1)["text"].alias("first_text"), F.element_at("responses", -1)["ordinal"].alias("last_ordinal"), F.aggregate("responses", F.lit(0).cast("long"), lambda s, r: s + r["token_count"]).alias("total_tokens"))


def boundary_groups(spark, d):
    return trajectories.boundary_groups(judged(spark, d), "persona").withColumn("accuracy", F.round("accuracy", 9))


def group_advantage(spark, d):
    rows = judged(spark, d).withColumn("reward", F.coalesce(F.col("is_correct").cast("double"), F.lit(0.0)))
    return trajectories.group_advantage(rows, "persona", "reward").select("doc_id", F.round("advantage", 6).alias("advantage"))


def rewards(spark, d):
    correct = F.coalesce(F.col("is_correct"), F.lit(False))
    total = trajectories.total_reward(correct, F.col("token_count"), F.col("text").endswith("."), 2000, 0.0001, 0.5)
    return judged(spark, d).withColumn("reward", F.round(total, 6))


def reward_total(spark, d):
    return rewards(spark, d).select("doc_id", "reward")


def distill_select(spark, d):
    return rewards(spark, d).where("reward = 1.0").select("doc_id", "persona")


def best_of_n(spark, d):
    return trajectories.best_of(rewards(spark, d), "persona", 3, F.desc("reward"), F.asc("doc_id")).select("persona", "place", "doc_id", "reward")


# -- generic ------------------------------------------------------------------------------


def join_smoke(spark, d):
    o, c, n = (table(spark, d, x) for x in ("orders", "customer", "nation"))
    line = table(spark, d, "lineitem").where("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    joined = o.join(line, "o_orderkey").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("q"), 2).alias("quantity"))


def event_windows(spark, d):
    e = table(spark, d, "events")
    out = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", "total")


QUERIES = (
    compose_prompts, clean_whitespace, normalize_math, last_number, parse_response, extract_math_answer, provider_answer, parse_vs_verify, extract_code, unsafe_code, code_static, verify_math,
    stop_truncate, gen_config, gsm8k_answer, mbpp_tests, validate_entries, dedup_first, ingest_pipeline, ingest_report, json_props, chatml_prompt, template_render, query_rewrite,
    chat_messages, api_payload, endpoint_url, grid_jobs, experiment_prompts, sampling_groups, batch_assign, resume_union, resume_anti, job_outcome_join, run_report, generate_mock,
    pairwise_jaccard, diversity_stats, diversity_score, correctness_stats, leaderboard, recipe_summary, spectrum_nested, boundary_groups, group_advantage, reward_total, distill_select,
    best_of_n, join_smoke, event_windows, with_ordinal, load_falsy, record_metadata, scan_json, scan_jsonl, scan_prompts, scan_rejects, grid_defaults, sampling_applied, verify_typed,
    scan_prompt_list, scan_hub, sink_committed, batch_dispatch, run_resumed, run_fresh, generate_sql, answer_parts, semantic_diversity, cosine_plugin, diversity_plugin,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}

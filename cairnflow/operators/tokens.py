"""Token ids with an injected tokenizer, one for each Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A picklable function that makes a tokenizer with encode(text) -> list[int] and decode(ids) -> str.
Factory = Callable[[], object]
_made: dict[tuple[str, str], object] = {}


def made(factory: Factory):
    """This worker's tokenizer of a factory, known by its module and name: the function itself is a new object in every task."""
    name = (getattr(factory, "__module__", ""), getattr(factory, "__qualname__", repr(factory)))
    if name not in _made:
        _made[name] = factory()
    return _made[name]


def encode(rows: DataFrame, factory: Factory, text_col: str = "text", max_length: int | None = None, keep: str = "start") -> DataFrame:
    """With token_ids (array<int>) and token_count; null texts count as empty.

    Of more than ``max_length`` ids those at the start are kept, or with ``keep`` end the last ones.
    """

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        tool = made(factory)
        return pd.Series([cut_ids(tool.encode(t or ""), max_length, keep) for t in texts])

    return rows.withColumn("token_ids", ids(F.col(text_col))).withColumn("token_count", F.size("token_ids"))


def cut_ids(ids: list[int], most: int | None, keep: str) -> list[int]:
    if most is None or len(ids) <= most:
        return ids
    return ids[:most] if keep == "start" else ids[len(ids) - most :]


def batched(rows: DataFrame, factory: Factory, batch_size: int = 16, side: str = "left", ids_col: str = "token_ids") -> DataFrame:
    """With batch, input_ids and attention_mask: rows in batches of equal width for a model, padded on one ``side``.

    Rows are dealt by ranges of their length and sorted by it, so that a batch's rows are of
    nearly one length and little is padding; rows of one length that most have go to many
    tasks.  A batch is ``batch_size`` neighbours in a task, the last one fewer; its width is
    its longest row's.  The padding id is the tokenizer's (:func:`pad_id`), 0 without one.  Null
    ids count as none.
    """
    size = F.coalesce(F.size(ids_col), F.lit(0))
    dealt = rows.withColumn("__size", F.greatest(size, F.lit(0))).repartitionByRange("__size", F.xxhash64(ids_col)).sortWithinPartitions("__size")
    placed = dealt.withColumn("batch", F.floor(F.monotonically_increasing_id() / batch_size).cast("long"))
    # a task's first number is a multiple of 2**33, so no batch has rows of two tasks
    schema = StructType([*placed.drop("__size").schema.fields, *StructType.fromDDL("input_ids array<int>, attention_mask array<int>").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad = pad_id(made(factory)) or 0
        held: list[pa.Table] = []
        for b in batches:
            t = pa.Table.from_batches([b])
            number = t.column("batch").to_numpy()
            cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
            for i, k in zip(cuts, cuts[1:]):
                if held and held[0].column("batch")[0] != t.column("batch")[i]:
                    yield padded(pa.concat_tables(held), pad)
                    held = []
                held.append(t.slice(i, k - i))
        if held:
            yield padded(pa.concat_tables(held), pad)

    def padded(t: pa.Table, pad: int) -> pa.RecordBatch:
        ids = [x or [] for x in t.column(ids_col).to_pylist()]
        width = max(map(len, ids), default=0)
        blank = [[pad] * (width - len(x)) for x in ids]
        both = [b + x if side == "left" else x + b for x, b in zip(ids, blank)]
        off = [[0] * len(b) for b in blank]
        mask = [o + [1] * len(x) if side == "left" else [1] * len(x) + o for x, o in zip(ids, off)]
        out = t.drop_columns(["__size"]).append_column("input_ids", pa.array(both, pa.list_(pa.int32()))).append_column("attention_mask", pa.array(mask, pa.list_(pa.int32())))
        return out.combine_chunks().to_batches()[0]

    return placed.mapInArrow(work, schema)


def decode(rows: DataFrame, factory: Factory, ids_col: str = "token_ids", to: str = "text", skip_special: bool = False) -> DataFrame:
    """With the text of ids, padded ones too; ``skip_special`` leaves out the tokenizer's special ids (its all_special_ids and its padding)."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        tool = made(factory)
        gone = {*getattr(tool, "all_special_ids", ()), pad_id(tool)} if skip_special else set()
        return pd.Series([tool.decode([i for i in (x if x is not None else []) if i not in gone]) for x in ids])

    return rows.withColumn(to, text(F.col(ids_col)))


def pad_id(tool) -> int | None:
    """A tokenizer's padding id, by default its end-of-text id."""
    pad = getattr(tool, "pad_token_id", None)
    return getattr(tool, "eos_token_id", None) if pad is None else pad


def chat_prompt(rows: DataFrame, factory: Factory, system_col: str = "system_prompt", user_col: str = "user_prompt", to: str = "formatted_prompt", chatml: bool = True) -> DataFrame:
    """With the tokenizer's own chat template over system and user, open for the assistant.

    A tokenizer without a template, or whose template fails, gets ChatML, or with ``chatml``
    false the two texts with a blank line between.
    """

    @F.pandas_udf("string")
    def text(systems: pd.Series, users: pd.Series) -> pd.Series:
        tool = made(factory)

        def one(system: str, user: str) -> str:
            said = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": user}]
            try:
                return tool.apply_chat_template(said, tokenize=False, add_generation_prompt=True)
            except Exception:  # noqa: BLE001  templates are programs of their own
                if not chatml:
                    return f"{system}\n\n{user}"
                return "".join(f"<|im_start|>{role}\n{x}<|im_end|>\n" for role, x in (("system", system), ("user", user))) + "<|im_start|>assistant\n"

        return pd.Series([one(s or "", u or "") for s, u in zip(systems, users)])

    return rows.withColumn(to, text(F.col(system_col), F.col(user_col)))

"""Group aggregates as plug-ins: init, update, merge and finish, over Arrow, with partial states before the shuffle.

A task updates one state for each group as its batches pass and gives the states out, so what
is shuffled is a state for each group and task, however many rows a group has; states of a
group are merged as they come, one after the other.  States are columns of a declared type.

An aggregate whose state grows with a group's distinct values names a column in ``spread_by``: a group is then
dealt by that column's hash to SHARES shares, and ``close`` makes a share's state small before
the shares meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: States that a task holds before it gives them out.
MOST_STATES = 50_000
#: Shares of a group whose state is spread.
SHARES = 64


class Aggregate:
    """A plug-in.  ``inputs`` are the columns that it reads, ``state`` and ``result`` declare columns of its own."""

    inputs: tuple[str, ...] = ()
    state = "n long"
    result = "n long"
    spread_by: str | None = None

    def init(self) -> dict:
        """The state of no rows."""
        raise NotImplementedError

    def update(self, state: dict, rows: pa.Table) -> dict:
        """The state with some of a group's rows taken in."""
        raise NotImplementedError

    def merge(self, a: dict, b: dict) -> dict:
        """The state of both; the order of a group's states is open."""
        raise NotImplementedError

    def close(self, state: dict) -> dict:
        """A share's whole state made small, where the aggregate is spread."""
        return state

    def finish(self, state: dict) -> dict:
        """The result of a group."""
        raise NotImplementedError


_aggregates: dict[str, Aggregate] = {}


def register(name: str, aggregate: Aggregate) -> None:
    """Register an aggregate; a second one of a name takes its place."""
    _aggregates[name] = aggregate


def named(name: str) -> Aggregate:
    if name not in _aggregates:
        raise KeyError(f"no aggregate {name!r}; there are {sorted(_aggregates)}")
    return _aggregates[name]


def rows_of_states(held: dict[tuple, dict], keys: list[str], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(keys, k)) | s for k, s in held.items()], schema=schema)


def partial(batches: Iterator[pa.RecordBatch], keys: list[str], aggregate: Aggregate, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One state of each group for what a task reads, or more where it has more than MOST_STATES groups."""
    held: dict[tuple, dict] = {}
    for batch in batches:
        table = pa.Table.from_batches([batch])
        places = table.select(keys).append_column("__row", pa.array(range(table.num_rows), pa.int64()))
        for group in places.group_by(keys, use_threads=False).aggregate([("__row", "list")]).to_pylist():
            key = tuple(group[k] for k in keys)
            mine = table.select(list(aggregate.inputs)).take(pa.array(group["__row_list"]))
            held[key] = aggregate.update(held[key] if key in held else aggregate.init(), mine)
        if len(held) > MOST_STATES:
            yield rows_of_states(held, keys, schema)
            held = {}
    if held:
        yield rows_of_states(held, keys, schema)


def merged(batches: Iterator[pa.RecordBatch], keys: list[str], aggregate: Aggregate, close: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row for each group from states sorted by ``keys``: closed states, or results."""
    last: tuple | None = None
    state: dict = {}
    done: dict[tuple, dict] = {}
    end = aggregate.close if close else aggregate.finish
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row.pop(k) for k in keys)
            if key == last:
                state = aggregate.merge(state, row)
                continue
            if last is not None:
                done[last] = end(state)
            last, state = key, row
            if len(done) >= 1000:
                yield rows_of_states(done, keys, schema)
                done = {}
    if last is not None:
        done[last] = end(state)
        yield rows_of_states(done, keys, schema)


def aggregated(rows: DataFrame, by: str | list[str], aggregate: str | Aggregate) -> DataFrame:
    """One row for each group of ``by``: its columns and the aggregate's result.  A null is a group of its own; no rows give no groups."""
    plug = named(aggregate) if isinstance(aggregate, str) else aggregate
    by = [by] if isinstance(by, str) else by
    kinds = {c: rows.schema[c].dataType.simpleString() for c in by}
    ddl = lambda names, columns: ", ".join([f"`{c}` {kinds.get(c, 'int')}" for c in names] + [columns])
    arrow = lambda text: to_arrow_schema(StructType.fromDDL(text))

    keys = by
    given = rows.select(*dict.fromkeys([*by, *plug.inputs]))
    if plug.spread_by is not None:
        given, keys = given.withColumn("__share", F.pmod(F.xxhash64(plug.spread_by), F.lit(SHARES)).cast("int")), [*by, "__share"]
    form = ddl(keys, plug.state)
    schema = arrow(form)
    states = given.mapInArrow(lambda b: partial(b, keys, plug, schema), form)
    if plug.spread_by is not None:
        shares = states.repartition(*keys).sortWithinPartitions(*keys)
        states = shares.mapInArrow(lambda b: merged(b, keys, plug, True, schema), form).drop("__share")
    out = ddl(by, plug.result)
    result = arrow(out)
    return states.repartition(*by).sortWithinPartitions(*by).mapInArrow(lambda b: merged(b, by, plug, False, result), out)


class Lengths(Aggregate):
    """Counts, lengths of texts, and token counts of rows that have tokens: what of lexical diversity is sums and extremes."""

    state = "n long, known long, chars long, low long, high long, with_tokens long, tokens long, fewest long, most long"
    result = "total_responses long, avg_chars double, min_chars int, max_chars int, avg_tokens double, min_tokens long, max_tokens long"

    def __init__(self, text: str = "text", tokens: str = "token_count"):
        self.text, self.tokens, self.inputs = text, tokens, (text, tokens)

    def init(self) -> dict:
        return {"n": 0, "known": 0, "chars": 0, "low": None, "high": None, "with_tokens": 0, "tokens": 0, "fewest": None, "most": None}

    def update(self, state: dict, rows: pa.Table) -> dict:
        chars = pc.utf8_length(rows.column(self.text).cast(pa.string()))
        tokens = rows.column(self.tokens)
        tokens = tokens.filter(pc.fill_null(pc.greater(tokens, 0), False))
        ends, some = pc.min_max(chars).as_py(), pc.min_max(tokens).as_py()
        here = {
            "n": rows.num_rows, "known": rows.num_rows - chars.null_count, "chars": pc.sum(chars).as_py() or 0, "low": ends["min"], "high": ends["max"],
            "with_tokens": len(tokens), "tokens": pc.sum(tokens).as_py() or 0, "fewest": some["min"], "most": some["max"],
        }
        return self.merge(state, here)

    def merge(self, a: dict, b: dict) -> dict:
        of = lambda pick, name: pick((v for v in (a[name], b[name]) if v is not None), default=None)
        return {k: of(min, k) if k in ("low", "fewest") else of(max, k) if k in ("high", "most") else a[k] + b[k] for k in a}

    def finish(self, s: dict) -> dict:
        return {
            "total_responses": s["n"], "avg_chars": s["chars"] / s["known"] if s["known"] else None, "min_chars": s["low"], "max_chars": s["high"],
            "avg_tokens": s["tokens"] / s["with_tokens"] if s["with_tokens"] else 0.0, "min_tokens": s["fewest"] or 0, "max_tokens": s["most"] or 0,
        }


class Distinct(Aggregate):
    """Exact counts of a column's values that aren't null, told apart by 128 bits; spread, so no state holds all of a group's."""

    state = "n long, seen array<binary>"
    result = "n_distinct long"

    def __init__(self, column: str):
        self.column, self.inputs, self.spread_by = column, (column,), column

    def init(self) -> dict:
        return {"n": 0, "seen": []}

    def update(self, state: dict, rows: pa.Table) -> dict:
        from hashlib import blake2b

        values = pc.unique(rows.column(self.column).drop_null().cast(pa.string())).to_pylist()
        return {"n": 0, "seen": list({*state["seen"], *(blake2b(v.encode(), digest_size=16).digest() for v in values)})}

    def merge(self, a: dict, b: dict) -> dict:
        return {"n": a["n"] + b["n"], "seen": list({*a["seen"], *b["seen"]})}

    def close(self, state: dict) -> dict:
        return {"n": len(state["seen"]), "seen": []}

    def finish(self, state: dict) -> dict:
        return {"n_distinct": state["n"]}


class MeanCosine(Aggregate):
    """Mean cosine over all pairs of a group's vectors, from the norm of the sum of unit vectors; vectors that have no direction count as 0 in their pairs."""

    state = "n long, units long, total map<int,array<double>>"
    result = "n_vectors long, avg_cosine double"

    def __init__(self, vector: str = "embedding"):
        self.vector, self.inputs = vector, (vector,)

    def init(self) -> dict:
        return {"n": 0, "units": 0, "total": []}

    def update(self, state: dict, rows: pa.Table) -> dict:
        import numpy as np

        by_length: dict[int, list] = {}
        for v in rows.column(self.vector).to_pylist():
            x = np.array([np.nan] if v is None else v, dtype=np.float64)
            if len(x) and np.isfinite(x).all() and x.any():
                x = x / np.abs(x).max()
                by_length.setdefault(len(x), []).append(x / np.sqrt((x * x).sum()))
        here = {"n": rows.num_rows, "units": sum(map(len, by_length.values())), "total": [(d, np.sum(x, axis=0).tolist()) for d, x in by_length.items()]}
        return self.merge(state, here)

    def merge(self, a: dict, b: dict) -> dict:
        total = dict(a["total"])
        for d, x in b["total"]:
            total[d] = [p + q for p, q in zip(total[d], x)] if d in total else x
        return {"n": a["n"] + b["n"], "units": a["units"] + b["units"], "total": list(total.items())}

    def finish(self, s: dict) -> dict:
        both = sum(v * v for _, x in s["total"] for v in x) - s["units"]
        return {"n_vectors": s["n"], "avg_cosine": both / (s["n"] * (s["n"] - 1)) if s["n"] > 1 else 0.0}


register("lengths", Lengths())
register("distinct_texts", Distinct("text"))
register("distinct_answers", Distinct("extracted_answer"))
register("mean_cosine", MeanCosine())


def lexical(rows: DataFrame, group: str) -> DataFrame:
    """Lexical diversity by plug-ins: what :func:`.trajectories.diversity` gives but for similarity and score."""
    out = aggregated(rows, group, "lengths")
    for name, plug in (("unique_texts", "distinct_texts"), ("unique_answers", "distinct_answers")):
        other = aggregated(rows, group, plug).select(F.col(group).alias("__of"), F.col("n_distinct").alias(name))
        out = out.join(other, F.col(group).eqNullSafe(F.col("__of"))).drop("__of")
    return out.withColumn("duplicates", F.col("total_responses") - F.col("unique_texts"))

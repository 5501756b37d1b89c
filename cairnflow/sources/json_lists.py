"""JSON lists of any size, read in byte ranges.

A file that holds one list has no lines to split at, so it is read in the pieces between its
commas: Spark's text reader cuts at any separator, splits of a file included.  What a comma
is depends on all that comes before it: whether it stands in a string, and how deep.

1. One pass tells for each split what it does to that state, for both cases, beginning in a
   string or outside: whether quotes turn it around, the change of depth, and how many commas
   stand at the lowest depths.
2. Running sums of these, over one small row for each split, give every split the state it
   begins in, and the number of the element that it begins in.
3. Then each split cuts its own elements.  Only the first and the last piece of a split may
   belong to an element of its neighbours; these are put together by the element's number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.json import parsed, parsed_or_raise
from ..session import checkpointed

QUOTE, BACKSLASH = b'"'[0], b"\\"[0]
#: What a byte outside of strings is to the structure, and which bytes are neither blank nor a comma.
COMMA, OPEN, CLOSE = 1, 2, 3
KIND = np.zeros(256, dtype=np.int8)
KIND[list(b",")], KIND[list(b"[{")], KIND[list(b"]}")] = COMMA, OPEN, CLOSE
SOLID = np.ones(256, dtype=bool)
SOLID[list(b" \t\r\n,")] = False
#: Bytes of pieces that are looked at together.
SLICE = 4 << 20


class NotAList(ValueError):
    """The file's root is something else, or its brackets or quotes don't match."""


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): what stands between commas, in order within each block of a file."""
    rows = spark.read.text(path, lineSep=",")
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def real_quotes(data: np.ndarray) -> np.ndarray:
    """Where quotes stand that no backslash escapes: those behind an even run of backslashes."""
    quotes = np.flatnonzero(data == QUOTE)
    escaped = quotes[(quotes > 0) & (data[quotes - 1] == BACKSLASH)]
    if not len(escaped):
        return quotes
    other = np.flatnonzero(data != BACKSLASH)
    before = np.searchsorted(other, escaped) - 1  # the last other byte in front
    run = escaped - 1 - np.where(before >= 0, other[before], -1)
    return np.setdiff1d(quotes, escaped[run % 2 == 1], assume_unique=True)


class Marks:
    """The bytes of some pieces with commas behind each, and for the state they begin in: where commas outside of strings stand, and how deep."""

    def __init__(self, data: np.ndarray):
        self.data, self.quotes = data, real_quotes(data)

    def seen(self, inside: bool) -> tuple[np.ndarray, np.ndarray, int]:
        """(commas, their depths from 0 at the start, depth at the end)."""
        at = np.flatnonzero(KIND[self.data])
        at = at[(np.searchsorted(self.quotes, at) + inside) % 2 == 0]
        kind = KIND[self.data[at]]
        depth = np.cumsum((kind == OPEN).astype(np.int64) - (kind == CLOSE))
        comma = kind == COMMA
        return at[comma], depth[comma], int(depth[-1]) if len(depth) else 0


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array]]:
    """(file, block, some of its pieces), blocks one after the other."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column("block").to_numpy()
        file = batch.column("file").dictionary_encode()
        code = file.indices.to_numpy()
        size = np.cumsum(pc.binary_length(batch.column("value")).to_numpy(zero_copy_only=False)) // SLICE
        new = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (code[1:] != code[:-1]) | (size[1:] != size[:-1]), True])
        for a, b in zip(new, new[1:]):
            yield file.dictionary[int(code[a])].as_py(), int(block[a]), batch.column("value").slice(a, b - a)


def joined(values: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.encode("utf-8", "surrogatepass") + b"," for x in values.to_pylist()), dtype=np.uint8)


#: For each state s (0 outside, 1 in a string): depth, lowest depth of a comma, commas there and one above.
CASES = [f"{name}{s}" for s in (0, 1) for name in ("depth", "low", "there", "above")]
SUMMARY = "file string, block long, turns boolean, " + ", ".join(f"{c} long" for c in CASES) + ", first string, last string, solid long"
NONE = 1 << 62


class Summary:
    """What a block does to the state it begins in, in both cases; its first and last solid bytes, and how many of them, 3 for more."""

    def __init__(self) -> None:
        self.turns, self.depth, self.commas = False, [0, 0], [{}, {}]
        self.first = self.last = None
        self.solid = 0

    def add(self, data: np.ndarray) -> None:
        marks = Marks(data)
        for s in (0, 1):
            _, depth, end = marks.seen(bool(s) != self.turns)
            commas: dict[int, int] = self.commas[s]
            for d, n in zip(*(x.tolist() for x in np.unique(depth + self.depth[s], return_counts=True))):
                commas[d] = commas.get(d, 0) + n
            low = min(commas, default=NONE)  # only the two lowest can be the list's own
            self.commas[s] = {d: n for d, n in commas.items() if d <= low + 1}
            self.depth[s] += end
        self.turns = self.turns != bool(len(marks.quotes) % 2)
        shown = np.flatnonzero(SOLID[data])
        if len(shown):
            self.first = self.first or chr(data[shown[0]])
            self.last, self.solid = chr(data[shown[-1]]), min(3, self.solid + len(shown))

    def row(self, file: str, block: int) -> pa.RecordBatch:
        values = [file, block, self.turns]
        for depth, commas in zip(self.depth, self.commas):
            low = min(commas, default=NONE)
            values += [depth, low, commas.get(low, 0), commas.get(low + 1, 0)]
        values += [self.first, self.last, self.solid]
        return pa.RecordBatch.from_pylist([dict(zip(schema().names, values))], schema=schema())


def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of SUMMARY for each block."""
    now, summary = None, Summary()
    for file, block, values in by_block(batches):
        if now != (file, block):
            if now is not None:
                yield summary.row(*now)
            now, summary = (file, block), Summary()
        summary.add(joined(values))
    if now is not None:
        yield summary.row(*now)


def schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in SUMMARY.split(", "))])


def starts(summary: DataFrame) -> DataFrame:
    """For each block the state it begins in: inside, depth, and element, the number of the element over all files; with what its file must end in."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col("turns").cast("long")).over(earlier), F.lit(0)) % 2 == 1
    rows = summary.withColumn("inside", inside)
    of = lambda name: F.when(F.col("inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    rows = rows.select("file", "block", "inside", "turns", "first", "last", of("depth").alias("change"), of("low").alias("low"), of("there").alias("there"), of("above").alias("above"), "solid")
    rows = rows.withColumn("depth", F.coalesce(F.sum("change").over(earlier), F.lit(0)))
    # the list's own commas stand at depth 1; the one that stands for the file's end at 0
    own = F.when(F.col("depth") + F.col("low") == 1, F.col("there")).when(F.col("depth") + F.col("low") == 0, F.col("above")).otherwise(F.lit(0))
    rows = rows.withColumn("own", own.cast("long"))
    known = lambda c: F.when(F.col(c).isNotNull(), F.col("block"))
    elements = F.when((F.sum("own") == 0) & (F.sum("solid") == 2), 0).otherwise(F.sum("own") + 1)  # none in an empty list
    files = rows.groupBy("file").agg(
        elements.alias("elements"), F.sum("change").alias("ends"), (F.sum(F.col("turns").cast("long")) % 2).alias("open"), F.min_by("first", known("first")).alias("begins_with"), F.max_by("last", known("last")).alias("ends_with")
    )
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("before", F.coalesce(F.sum("elements").over(before), F.lit(0)))
    return rows.join(files, "file").withColumn("element", F.col("before") + F.coalesce(F.sum("own").over(earlier), F.lit(0)))


def cut(batches: Iterator[pa.RecordBatch], fragments: bool) -> Iterator[pa.RecordBatch]:
    """(element, block, file, text): whole elements of each block, or with ``fragments`` what stands at its two ends.

    Rows are a block's pieces with the state that it begins in.  A fragment that a comma of the
    list's own ends has no comma behind.
    """
    now, inside, depth, element, held, begun = None, False, 0, 0, [], False

    def row(text: bytes) -> tuple[int, int, str, str]:
        return element, now[1], now[0], text.decode("utf-8", "surrogatepass")

    def batch(rows: list[tuple[int, int, str, str]]) -> pa.RecordBatch:
        kinds = {"element": pa.int64(), "block": pa.int64(), "file": pa.string(), "text": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))

    out: list[tuple[int, int, str, str]] = []
    for source in batches:
        at = 0
        for file, block, values in by_block(iter([source])):
            if now != (file, block):
                if now is not None and fragments:
                    out.append(row(b"".join(held)))
                given = {c: source.column(c)[at].as_py() for c in ("inside", "depth", "element")}
                now, inside, depth, element, held, begun = (file, block), given["inside"], given["depth"], given["element"], [], False
            at += len(values)
            data = joined(values)
            marks = Marks(data)
            commas, deep, end = marks.seen(inside)
            ends = commas[deep + depth == 1]
            raw, last = data.tobytes(), 0
            for e in ends.tolist():
                if begun != fragments:  # an element of the block's own, or the end of one that began before
                    out.append(row(b"".join([*held, raw[last:e]])))
                held, last, begun, element = [], e + 1, True, element + 1
            if fragments or begun:
                held.append(raw[last:])
            inside, depth = inside != bool(len(marks.quotes) % 2), depth + end
            if len(out) >= 1000:
                yield batch(out)
                out = []
    if now is not None and fragments:
        out.append(row(b"".join(held)))
    if out:
        yield batch(out)


def scan(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(ordinal, raw) of a file, or a folder of files, each of which holds one JSON list; raises :class:`NotAList` for any other.

    Ordinals go on through files in the order of their names; an empty list has no elements.
    An element that isn't JSON raises when it is read, or without ``strict`` has a null raw.
    """
    rows = pieces(spark, path)
    where = checkpointed(starts(checkpointed(rows.mapInArrow(summarised, SUMMARY))))
    right = (F.col("ends") == 0) & (F.col("open") == 0) & (F.col("begins_with") == "[") & (F.col("ends_with") == "]")
    bad = where.where(~F.coalesce(right, F.lit(False))).select("file").first()
    if bad is not None or where.isEmpty():
        raise NotAList(f"{bad[0] if bad is not None else path} isn't a JSON list")
    # a row of a few numbers for each split, of which the driver holds more itself
    known = F.broadcast(where.select(F.col("file").alias("f"), F.col("block").alias("b"), "inside", "depth", "element"))
    placed = rows.join(known, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).select("file", "block", "value", "inside", "depth", "element")
    form = "element long, block long, file string, text string"
    inner = placed.mapInArrow(lambda b: cut(b, False), form).select("element", "text")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"])
    ends = placed.mapInArrow(lambda b: cut(b, True), form).groupBy("file", "element").agg(F.array_join(parts, "").alias("text"))
    edges = where.groupBy("file").agg(F.min("element").alias("opens"), F.max(F.col("element") + F.col("own")).alias("closes"), F.first("elements").alias("elements"))
    ends = ends.join(F.broadcast(edges), "file").where("elements > 0")
    # the list's own brackets, and the comma that stands for the file's end
    opened = F.when(F.col("element") == F.col("opens"), F.regexp_replace("text", r"^\s*\[", "")).otherwise(F.col("text"))
    closed = F.when(F.col("element") == F.col("closes"), F.regexp_replace(opened, r"\]\s*,?\s*$", "")).otherwise(opened)
    both = inner.union(ends.select("element", closed.alias("text")))
    return both.select(F.col("element").alias("ordinal"), (parsed_or_raise if strict else parsed)(F.col("text")).alias("raw"))

"""URL filters: a trie over reversed host labels, then path segments, with longest-match precedence.

The trie of all rules is built once on the driver, checked against ``most_bytes`` and sent
to every executor; a URL walks it label by label from the right of its host, then segment
by segment from the left of its path, and the deepest entry met decides.  One pass over the
input, no shuffle.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

RULE, PATHS, LENGTHS = 0, 1, 2  # keys of a node beside its labels or segments, which are strings


class Trie:
    """host label nodes hold, under PATHS, a trie over path segments; RULE holds (rule, verdict).

    A rule's path is a plain prefix.  Its last segment may be partial (``/en`` also fits
    ``/english``), so a segment node keeps such ends beside its full segments, with their
    lengths, the longest first: a segment of any length is looked up once for each of these.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(label, {})
            node = node.setdefault(PATHS, {})
            *full, last = path.split("/")
            for segment in full:
                node = node.setdefault(segment, {})
            ends = node.setdefault(RULE, {})
            # block wins over allow where both name the same place
            if ends.get(last, ("", "allow"))[1] == "allow":
                ends[last] = (host + path, verdict)
            node[LENGTHS] = sorted({*map(len, ends)}, reverse=True)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest entry that fits: more host labels first, then the longer path."""
        best, node = None, self.root
        labels = host.split(".")
        segments = path.split("/")
        best = self.in_path(node, segments) or best
        for label in reversed(labels):
            node = node.get(label)
            if node is None:
                break
            best = self.in_path(node, segments) or best
        return best

    @staticmethod
    def in_path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        node, best = node.get(PATHS), None
        for i, segment in enumerate(segments):
            if node is None:
                break
            ends = node.get(RULE)
            if ends:
                best = next((ends[segment[:n]] for n in node[LENGTHS] if n <= len(segment) and segment[:n] in ends), best)
            node = node.get(segment)
        return best


def parts(url: str | None) -> tuple[str, str]:
    """(host, path): after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then up to ``?``, ``#`` or the end."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    stop = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:stop].partition("/")
    return host.translate(LOWER), slash + path


LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow", most_bytes: int = 64 << 20) -> DataFrame:
    """One row per input row: ``id_col``, host, path, rule and verdict.

    ``rules`` are (verdict, host, path prefix); a rule fits its host and all subdomains.  The
    longest rule wins (host labels first, then path); where an allow and a block entry name
    the same host and path, block wins.  Without a fitting rule, ``rule`` is null and the
    verdict is ``default``.  A null url, or one without ``://``, has an empty host and path.
    Ids may be null or repeated; other columns aren't read; an empty table gives an empty
    result.  A url of any length is judged whole, in linear time.  Rules whose trie is larger than ``most_bytes`` raise ValueError.
    """
    spark = pages.sparkSession
    packed = pickle.dumps(Trie(rules))
    if len(packed) > most_bytes:
        raise ValueError(f"the rules take {len(packed)} bytes; the bound is {most_bytes}")
    sent = spark.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie: Trie = pickle.loads(sent.value)
        for b in batches:
            split = [parts(u) for u in b.column(1).to_pylist()]
            found = [trie.find(h, p) for h, p in split]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([h for h, _ in split], pa.string()),
                    pa.array([p for _, p in split], pa.string()),
                    pa.array([f and f[0] for f in found], pa.string()),
                    pa.array([f[1] if f else default for f in found], pa.string()),
                ],
                ["id", "host", "path", "rule", "verdict"],
            )

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"))
    return rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)

"""Repeated passages, found with enhanced suffix arrays and removed but for their first copy.

Every byte that a repeat of ``least`` bytes covers is removed unless the repeat starts
nowhere earlier (smaller document, or same document and earlier start).

1. *Anchors.*  In each stretch of ``least`` bytes the k-byte string with the smallest hash
   owns it; neighbouring stretches with one owner form a segment (at most 2 * least - k
   bytes).  Equal stretches have equal owners, so equal stretches lie in segments of one key,
   the hash of the k bytes.  Some 3 % of the positions are anchors, and only those are dealt.
2. *Equal segments.*  Of equal segments all but the first are repeats throughout.  Those that
   aren't first in their own slice of the input are settled before anything is dealt.  A key
   with ``hot_from`` distinct segments among what a task has read so far is hot (a phrase that a
   large part of the corpus holds in ever other surroundings): its segments are dealt by their
   own hashes, and a marker tells the key's task that they are.  What a task forgets are keys
   with fewer than one segment in FORGET slices, so a key that no task takes for hot has at
   most one row for some 24 MB of the corpus, and ``hot_from`` for each task; they are read as
   a stream.
3. *Unequal segments with one key* are where repeats begin and end.  Of each distinct segment
   its first copy takes part: an enhanced suffix array over a batch of whole keys is scanned
   with a stack, which gives the tree of common-prefix intervals; an interval of ``least``
   bytes or more whose members differ in the byte to their left is a maximal repeat, with
   all its occurrences.  All stretches that it covers are repeats but for the earliest.
   Hot keys, and keys with more distinct segments than ``most_segments``, go by the hashes of
   their single stretches instead, which are dealt by hash; the result is the same.  So of the
   three ways to find repeats only this one is the interval tree's: equal segments, most of
   all anchors in a corpus with many copies, are settled by hash in step 2, some 5 % of the
   anchors come to a suffix array, and few go by single stretches.
4. The documents are joined with their marks and cut.

No key, document or group of copies is gathered whole: step 2 reads sorted rows as a
stream, and memory is bounded by a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_slices, shuffle_partitions, strings

#: Bytes whose hash names a segment.
KEY_BYTES = 32
SETTLED, CANDIDATE, HOT = 0, 1, 2
#: Slices of which a key must have a segment in one to be remembered, and segments that a task remembers.
FORGET, REMEMBER = 4, 8_000_000
#: In place of a segment's hash: a marker of a hot key; it sorts before the key's segments.
MARKER = -1


def versions(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """What tells rows apart that share an id: 64 bits of a hash of the text; 0 where every id stands once, which a count of the ids tells."""
    ids = docs.select(docs[id_col].alias("id")).agg(F.count("*"), F.count("id"), F.count_distinct("id")).first()
    alone = ids[1] == ids[2] and ids[0] - ids[1] <= 1
    return F.lit(0).cast("long") if alone else F.xxhash64(F.coalesce(docs[text_col], F.lit("")))


def against_first(new: np.ndarray, *place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(later, alike) of rows sorted by group and place, of which ``new`` begin a group.

    Later rows stand elsewhere than their group's first.  The others are its first and what is
    alike in id, version and start: further rows of one document, which are no repeats of it.
    """
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    alike = np.logical_and.reduce([p == p[first] for p in place])
    return ~alike, alike & ~new


def owners(data: np.ndarray, starts: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start, count of starts, owner) of each segment in texts that lie end to end.

    ``starts`` has the texts' first positions and the end.  Hashes are compared with their
    positions, so of equal ones the leftmost owns.
    """
    n, window = len(data), least - k + 1
    none = np.zeros(0, dtype=np.int64)
    if n < least:
        return none, none, none, none
    h = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    width, power = 1, 0x01000193
    while width < k:
        wide = h.copy()
        wide[width:] += h[:-width] * np.uint32(power)
        h, width, power = wide, 2 * width, power * power & 0xFFFFFFFF
    h = h[k - 1 :]  # of the k bytes from each position
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    low = h.astype(np.uint64) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= window:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < window:
        low = np.minimum(low[: len(low) - (window - width)], low[window - width :])
    owner = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the stretch from each position
    ends = starts[1:]
    text = np.repeat(np.arange(len(ends)), np.diff(starts))[: len(owner)]
    valid = np.arange(len(owner)) + least <= ends[text]
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, none, none
    new = np.ones(len(at), dtype=bool)
    new[1:] = (owner[at[1:]] != owner[at[:-1]]) | (text[at[1:]] != text[at[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    return text[at[first]], at[first], count, owner[at[first]]


class Recent:
    """Distinct segments of each key that a task has met, to tell hot keys; what it forgets costs no result."""

    def __init__(self, hot_from: int):
        self.hot_from, self.slices = hot_from, 0
        self.pairs = np.zeros(0, dtype=np.int64)  # sorted hashes of (key, same)
        self.keys, self.counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def hot(self, key: np.ndarray, same: np.ndarray) -> np.ndarray:
        """The hot ones among the keys of a slice's distinct segments; remembers these."""
        pair = np.unique(key * 0x2545F4914F6CDD1D ^ same, return_index=True)
        place = np.searchsorted(self.pairs, pair[0])
        known = place < len(self.pairs)
        known[known] = self.pairs[place[known]] == pair[0][known]
        keys, at = np.unique(np.concatenate([self.keys, key[pair[1][~known]]]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([self.counts, np.ones((~known).sum(), dtype=np.int64)]), minlength=len(keys)).astype(np.int64)
        self.slices += 1
        if len(self.pairs) < REMEMBER:
            self.pairs = np.insert(self.pairs, place[~known], pair[0][~known])
        else:
            self.pairs = pair[0]
        hot = np.intersect1d(keys[counts >= self.hot_from], key)
        stay = counts > self.slices // FORGET
        self.keys, self.counts = keys[stay], counts[stay]
        return hot


def segments(batches: Iterator[pa.RecordBatch], least: int, hot_from: int) -> Iterator[pa.RecordBatch]:
    """(kind, key, same, id, a, v, n): segments; those that are not first of their equals in a slice are settled.

    Of rows alike in id and text the first stands for all, as marks are joined to each.
    """
    from xxhash import xxh3_64_intdigest

    recent = Recent(hot_from)

    def work(b: pa.RecordBatch) -> pa.RecordBatch | None:
        raw = [t.encode("utf-8", "surrogatepass") for t in strings(b.column(1))]
        flat = b"".join(raw)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        found = []
        whole = np.frombuffer(flat, dtype=np.uint8)
        cuts = np.flatnonzero(np.diff(starts[:-1] >> 20, prepend=-1)).tolist() + [len(raw)]  # texts of about 1 MB at a time
        for i, j in zip(cuts, cuts[1:]):
            base = starts[i]
            t, a, n, p = owners(whole[base : starts[j]], starts[i : j + 1] - base, least, KEY_BYTES)
            found.append((t + i, a + base, n, p + base))
        text, a, n, p = map(np.concatenate, zip(*found))
        if not len(a):
            return None
        mask = (1 << 63) - 1
        key = np.fromiter((xxh3_64_intdigest(flat[i : i + KEY_BYTES]) & mask for i in p.tolist()), dtype=np.int64, count=len(p))
        same = np.fromiter((xxh3_64_intdigest(flat[i:j]) & mask for i, j in zip(a.tolist(), (a + n + least - 1).tolist())), dtype=np.int64, count=len(p))
        v = b.column(2).to_numpy()[text]
        ids = b.column(0).take(pa.array(text))
        at = a - starts[text]
        rank = rank_of(b.column(0))[text]
        order = np.lexsort((at, v, rank, same, key))
        key, same, v, n, at, rank, ids = key[order], same[order], v[order], n[order], at[order], rank[order], ids.take(pa.array(order))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (same[1:] != same[:-1])
        later, alike = against_first(new, rank, v, at)
        if alike.any():
            key, same, v, n, at, later = (x[~alike] for x in (key, same, v, n, at, later))
            ids = ids.filter(pa.array(~alike))
        hot = recent.hot(key[~later], same[~later])
        kind = np.where(later, SETTLED, np.where(np.isin(key, hot), HOT, CANDIDATE)).astype(np.int8)
        key[later] = same[later] = 0
        m = len(hot)
        columns = [
            pa.array(np.append(kind, np.full(m, CANDIDATE, dtype=np.int8))),
            pa.array(np.append(key, hot)),
            pa.array(np.append(same, np.full(m, MARKER))),
            pa.concat_arrays([ids, pa.nulls(m, ids.type)]),
            pa.array(np.append(at, np.zeros(m)).astype(np.int32)),
            pa.array(np.append(v, np.zeros(m, dtype=np.int64))),
            pa.array(np.append(n, np.zeros(m)).astype(np.int8)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["kind", "key", "same", "id", "a", "v", "n"])

    yield from map_slices(batches, "text", work, 6 << 20)


def rank_of(ids: pa.Array) -> np.ndarray:
    """Positions of ids in order, nulls first, equal ids alike."""
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads segments sorted by kind, key, same, id, version and start.

    Repeats of a segment are settled.  Firsts become HOT if they are, or if a marker says
    that their key is; else they stay candidates if their key has another segment.
    """
    names = ["kind", "key", "id", "a", "v", "n"]
    held: pa.RecordBatch | None = None  # the last first, its neighbour not yet known
    tied = False  # it has one on the left
    last: pa.RecordBatch | None = None  # the first row of the last group of equals
    marked = None

    def of_kind(rows: pa.RecordBatch, kind: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, kind, dtype=np.int8)), *rows.columns[1:]], names)

    for b in batches:
        if not b.num_rows:
            continue
        prior = int(last is not None)
        if prior:
            b = pa.concat_batches([last, b])
        kind, key, same, a, v = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4, 5))
        new = np.ones(len(key), dtype=bool)
        new[1:] = (kind[1:] != kind[:-1]) | (key[1:] != key[:-1]) | (same[1:] != same[:-1])
        again, alike = (x[prior:] for x in against_first(new, rank_of(b.column(3)), v, a))
        last = b.slice(int(np.flatnonzero(new)[-1]), 1)
        b, kind, key, same = b.slice(prior), kind[prior:], key[prior:], same[prior:]
        marker = (same == MARKER) & (kind == CANDIDATE)
        gone = (again | (kind == SETTLED)) & ~marker
        over = marker | alike & (kind != SETTLED)
        hot_keys = key[marker]
        hot = (kind == HOT) | (kind == CANDIDATE) & (np.isin(key, hot_keys) | (key == marked if marked is not None else False))
        if len(hot_keys):
            marked = hot_keys[-1]
        out = b.select(names)
        for chosen, as_kind in ((gone, SETTLED), (hot & ~gone & ~over, HOT)):
            if chosen.any():
                yield of_kind(out.filter(pa.array(chosen)), as_kind)
        firsts = out.filter(pa.array(~gone & ~hot & ~over))
        if not firsts.num_rows:
            continue
        if held is not None:
            firsts = pa.concat_batches([held, firsts])
        k = firsts.column(1).to_numpy(zero_copy_only=False)
        left = np.concatenate([[tied], k[1:] == k[:-1]])
        right = np.concatenate([k[1:] == k[:-1], [False]])
        known = (left | right)[:-1]
        if known.any():
            yield firsts.slice(0, len(k) - 1).filter(pa.array(known))
        held, tied = firsts.slice(len(k) - 1), bool(left[-1])
    if held is not None and tied:
        yield held


# -- enhanced suffix arrays ---------------------------------------------------------------


def suffix_array(data: np.ndarray, chosen: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, common): the ``chosen`` positions sorted by the text from there, and for each
    the bytes that it has in common with the one before (0 for the first).

    Prefix doubling from eight bytes on until ``depth`` is passed; deeper common bytes count
    as that many.  The ranks of every level stay, and the common bytes are read off them.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    word = np.zeros(n, dtype=np.uint64)
    levels = []  # (width, ranks)
    for k in range(8):
        word = word << np.uint64(8) | padded[k : k + n]
        if k in (0, 1, 3):
            levels.append((k + 1, word.copy()))
    rank, width = dense(word), 8
    levels.append((8, rank))
    while width < depth:
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: n - width] = rank[width:] + 1
        rank, width = dense(rank << 32 | ahead), 2 * width
        levels.append((width, rank))
    suffixes = chosen[np.argsort(rank[chosen], kind="stable")]
    common = np.zeros(len(suffixes), dtype=np.int64)
    i, j = suffixes[1:], suffixes[:-1]
    for width, ranks in reversed(levels):
        p, q = np.minimum(i + common[1:], n - 1), np.minimum(j + common[1:], n - 1)
        inside = (i + common[1:] < n) & (j + common[1:] < n)
        common[1:] += width * ((ranks[p] == ranks[q]) & inside)
    return suffixes, common


def dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of the keys, equal ones alike."""
    order = np.argsort(keys)
    new = np.zeros(len(keys), dtype=np.int64)
    s = keys[order]
    new[1:] = s[1:] != s[:-1]
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def maximal_repeats(suffixes: np.ndarray, common: np.ndarray, left: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(from, to, length) of the common-prefix intervals ``suffixes[from:to]`` of at least
    ``least`` bytes whose members differ in what stands to their left.

    ``left`` is by suffix; its negative values (a text's start) differ from everything.  The
    text right of an interval differs by construction, so these are the maximal repeats.
    The array is cut where fewer than ``least`` bytes are common; a stretch whose members
    have one left neighbour holds no maximal repeat and is passed over; the others are
    scanned with a stack of open intervals.
    """
    out: list[tuple[int, int, int]] = []
    if len(suffixes) < 2:
        return out
    l = left[suffixes]
    inner = common >= least
    starts = np.flatnonzero(inner & ~np.concatenate([[False], inner[:-1]])) - 1
    stops = np.flatnonzero(inner & ~np.concatenate([inner[1:], [False]])) + 1
    if not len(starts):
        return out
    both = np.stack([starts, np.minimum(stops, len(l) - 1)], axis=1).ravel()
    low, high = np.minimum.reduceat(l, both)[::2], np.maximum.reduceat(l, both)[::2]
    if stops[-1] == len(l):
        low[-1], high[-1] = l[starts[-1] :].min(), l[starts[-1] :].max()
    for a, z in zip(*(x[(low != high) | (low < 0)].tolist() for x in (starts, stops))):
        depth, side = common[a:z].tolist(), l[a:z].tolist()
        stack: list[list] = []  # [length, first, left neighbour or None if several]
        for k in range(1, z - a + 1):
            now = depth[k] if k < z - a else 0
            first, seen = k - 1, side[k - 1] if side[k - 1] >= 0 else None
            while stack and stack[-1][0] > now:
                length, first, before = stack.pop()
                seen = before if before == seen else None
                if seen is None:
                    out.append((a + first, a + k, length))
                # what closes is a member of the interval around it
            if now >= least:
                if stack and stack[-1][0] == now:
                    if stack[-1][2] != seen:
                        stack[-1][2] = None
                else:
                    stack.append([now, first, seen])
    return out


def covered(texts: list[bytes], order: np.ndarray, least: int) -> list[list[tuple[int, int]]]:
    """For each text the ranges (from, to) that repeats of at least ``least`` bytes cover, without their earliest copies.

    ``order`` ranks the texts' first bytes: a copy is earlier if its text's rank plus its
    place there is smaller.
    """
    tails = [b"\xff" + i.to_bytes(4, "big") for i in range(len(texts))]  # no text holds the byte 255
    data = np.frombuffer(b"".join(x for pair in zip(texts, tails) for x in pair), dtype=np.uint8)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(lengths + 5) - lengths - 5
    text = np.repeat(np.arange(len(texts)), lengths + 5)
    at = np.arange(len(data)) - starts[text]
    chosen = np.flatnonzero(at + least <= lengths[text])
    suffixes, common = suffix_array(data, chosen, int(lengths.max(initial=8)))
    if len(suffixes) < 2:
        return [[] for _ in texts]
    rest = lengths[text[suffixes]] - at[suffixes]
    common[1:] = np.minimum(common[1:], np.minimum(rest[1:], rest[:-1]))
    left = np.concatenate([[-1], data[:-1].astype(np.int64)])
    left[starts] = -1
    edge = np.zeros(len(data) + 1, dtype=np.int64)
    place = order[text] + at
    for a, z, length in maximal_repeats(suffixes, common, left, least):
        members = suffixes[a:z]
        later = members[place[members] != place[members].min()]
        np.add.at(edge, later, 1)
        np.add.at(edge, later + length, -1)
    on = np.cumsum(edge)[:-1] > 0
    flips = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]])))
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for a, z in zip(flips[::2].tolist(), flips[1::2].tolist()):
        out[text[a]].append((a - int(starts[text[a]]), z - int(starts[text[a]])))
    return out


# -- stages -------------------------------------------------------------------------------


def fetch(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(key, h2, id, a, v, segment) of the candidates listed with each document.

    Hot ones come as single stretches, with no segment and two hashes as key and h2; those
    that aren't first in their slice are settled: h2 is 0, and the key spreads them.  Rows
    alike in id and text are read once in a slice.
    """
    names = ["key", "h2", "id", "a", "v", "segment"]

    def table(ids: pa.Array, found: list[tuple]) -> tuple[pa.Array, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        key, row, a, v, segment = zip(*found)
        return ids.take(pa.array(row)), np.array(v, dtype=np.int64), np.array(a, dtype=np.int64), list(segment), np.array(key, dtype=np.int64)

    def work(b: pa.RecordBatch) -> pa.RecordBatch | None:
        plain, hot, read = [], [], set()
        for i, (name, text, found, own) in enumerate(zip(*(b.column(k).to_pylist() for k in range(4)))):
            if not found or not text or (name, text) in read:
                continue
            read.add((name, text))
            raw = text.encode("utf-8", "surrogatepass")
            for c in found:
                segment = raw[c["a"] : c["a"] + c["n"] + least - 1]
                (hot if c["kind"] == HOT else plain).append((c["key"], i, c["a"], own, segment))
        out = []
        if plain:
            ids, v, a, segment, key = table(b.column(0), plain)
            out.append([pa.array(key), pa.array(np.zeros_like(key)), ids, pa.array(a.astype(np.int32)), pa.array(v), pa.array(segment, pa.binary())])
        if hot:
            ids, v, a, segment, _ = table(b.column(0), hot)
            row, at, h = stretches(ids, v, a, segment, least)
            spread = np.where(h[:, 1] == 0, (at * 0x9E3779B1 + row * 0x85EBCA6B) & ((1 << 62) - 1), h[:, 0])
            out.append([pa.array(spread), pa.array(h[:, 1]), ids.take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(v[row]), pa.nulls(len(row), pa.binary())])
        if not out:
            return None
        return pa.concat_batches([pa.RecordBatch.from_arrays(c, names) for c in out])

    yield from map_slices(batches, "text", work)


def stretches(ids: pa.Array, v: np.ndarray, a: np.ndarray, segments: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, two hashes) of every stretch; hashes are zero where an equal one stands earlier here, in another place."""
    from xxhash import xxh3_128_digest

    count = np.array([len(s) - least + 1 for s in segments])
    row = np.repeat(np.arange(len(segments)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = a[row] + step
    digest = [xxh3_128_digest(s[k : k + least]) for s in segments for k in range(len(s) - least + 1)]
    h = np.frombuffer(b"".join(digest), dtype=np.int64).reshape(-1, 2) | np.array([0, 1])  # the second is never zero
    place = places(ids, v, np.zeros_like(a))[row] + at
    order = np.lexsort((place, h[:, 1], h[:, 0]))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]).any(axis=1)
    h[order[against_first(new, place[order])[0]]] = 0
    return row, at, h


def places(ids: pa.ChunkedArray | pa.Array, v: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Ranks of places by id, version and start, far enough apart for a segment's bytes between starts in one document."""
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    rank = rank_of(ids)
    order = np.lexsort((v, rank))
    document = np.empty(len(order), dtype=np.int64)
    document[order] = np.cumsum(np.concatenate([[0], (np.diff(rank[order]) != 0) | (np.diff(v[order]) != 0)])) if len(order) else 0
    return document << 32 | a


MARK_SCHEMA = "h1 long, h2 long, id {kind}, v long, a int, length int"
MARK_NAMES = ["h1", "h2", "id", "v", "a", "length"]


def unequal(batches: Iterator[pa.RecordBatch], least: int, most_segments: int) -> Iterator[pa.RecordBatch]:
    """Marks from suffix arrays over whole keys; for keys of more than ``most_segments`` segments their single stretches, to be grouped by hash.

    Input sorted by key.  Rows with h1 = h2 = 0 are marks; the others are stretches.  Rows
    that come as stretches pass through.
    """
    held: list[pa.Table] = []  # whole keys, or the start of the open one
    streaming: int | None = None

    def arrays(t: pa.Table):
        return t.column("id").combine_chunks(), t.column("v").to_numpy().astype(np.int64), t.column("a").to_numpy().astype(np.int64)

    def solve(t: pa.Table) -> pa.RecordBatch | None:
        ids, v, a = arrays(t)
        found = covered(t.column("segment").to_pylist(), places(ids, v, a), least)
        row = np.repeat(np.arange(len(found)), [len(f) for f in found])
        if not len(row):
            return None
        spans = np.array([s for f in found for s in f], dtype=np.int64)
        zero = pa.array(np.zeros(len(row), dtype=np.int64))
        return pa.RecordBatch.from_arrays([zero, zero, ids.take(pa.array(row)), pa.array(v[row]), pa.array((a[row] + spans[:, 0]).astype(np.int32)), pa.array((spans[:, 1] - spans[:, 0]).astype(np.int32))], MARK_NAMES)

    def single(t: pa.Table) -> pa.RecordBatch:
        ids, v, a = arrays(t)
        row, at, h = stretches(ids, v, a, t.column("segment").to_pylist(), least)
        return pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), ids.take(pa.array(row)), pa.array(v[row]), pa.array(at.astype(np.int32)), pa.array(np.full(len(row), least, dtype=np.int32))], MARK_NAMES)

    def passed(b: pa.RecordBatch) -> pa.RecordBatch:
        h1, h2 = b.column("key").to_numpy(), b.column("h2").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(np.where(h2 == 0, 0, h1)), pa.array(h2), b.column("id"), b.column("v"), b.column("a"), pa.array(np.full(len(h1), least, dtype=np.int32))], MARK_NAMES)

    def parts(t: pa.Table) -> Iterator[pa.Table]:
        key = t.column("key").to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for i, j in zip(cuts, cuts[1:]):
            yield t.slice(i, j - i)

    def settled(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        if tables:
            out = solve(pa.concat_tables(tables))
            if out is not None:
                yield out

    whole: list[pa.Table] = []
    size = 0
    for b in batches:
        bare = b.column("segment").is_null()
        if bare.true_count:
            yield passed(b.filter(bare))
            b = b.filter(pc.invert(bare))
        if not b.num_rows:
            continue
        for t in parts(pa.Table.from_batches([b])):
            key = t.column("key")[0].as_py()
            if streaming == key:
                yield single(t)
                continue
            if held and held[0].column("key")[0].as_py() != key:
                whole += held
                size += sum(x.num_rows for x in held)
                held = []
                if size >= most_segments:
                    yield from settled(whole)
                    whole, size = [], 0
            held.append(t)
            if sum(x.num_rows for x in held) > most_segments:
                for x in held:
                    yield single(x)
                held, streaming = [], key
    yield from settled(whole + held)


def later_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks (id, v, a, length) from marks and stretches sorted by hash, id, version and start: a stretch like one that stands elsewhere before it is a repeat."""
    last: pa.RecordBatch | None = None  # the first row of the last hash
    for b in batches:
        if not b.num_rows:
            continue
        prior = int(last is not None)
        if prior:
            b = pa.concat_batches([last, b])
        h1, h2, v, a = (b.column(i).to_numpy() for i in (0, 1, 3, 4))
        new = np.ones(len(h1), dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        again, _ = against_first(new, rank_of(b.column(2)), v, a)
        last = b.slice(int(np.flatnonzero(new)[-1]), 1)
        r = b.slice(prior).filter(pa.array((again | (h2 == 0))[prior:]))
        if r.num_rows:
            yield r.select(["id", "v", "a", "length"])


def plain(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """The rows as id, text, v (the text's version), c0, c1 …, and the names of the columns that c0, c1 … stand for."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    named = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), versions(docs, id_col, text_col).alias("v"), *(docs[c].alias(f"c{i}") for i, c in enumerate(others)))
    return named, others


def repeats(rows: DataFrame, least: int = 100, most_segments: int = 4096, hot_from: int = 64) -> DataFrame:
    """Marks (id, v, a, length) of rows with the columns id, text and v: ranges of bytes that repeat something earlier.

    Further columns of ``rows`` aren't used, but dealt with the texts: a join of the result
    to the same ``rows`` then takes the same exchange, and texts are dealt once.
    """
    if not KEY_BYTES < least <= KEY_BYTES + 95:
        raise ValueError(f"least must be above {KEY_BYTES} and at most {KEY_BYTES + 95}")
    n = shuffle_partitions(rows.sparkSession)
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.select("id", "text", "v").mapInArrow(lambda b: segments(b, least, hot_from), f"kind tinyint, key long, same long, id {kind}, a int, v long, n tinyint")
    # settled rows only pass through, so they go anywhere; segments of hot keys need only meet their equals
    place = F.when(F.col("kind") == SETTLED, F.xxhash64("id", "a")).when(F.col("kind") == HOT, F.xxhash64("key", "same")).otherwise(F.col("key"))
    dealt = found.repartition(n, place)
    marks = dealt.sortWithinPartitions("kind", "key", "same", "id", "v", "a").mapInArrow(settle, f"kind tinyint, key long, id {kind}, a int, v long, n tinyint")
    marks = marks.select("kind", "key", "id", "v", "a", F.col("n").cast("int").alias("n"))
    settled = marks.where(F.col("kind") == SETTLED).select("id", "v", "a", (F.col("n") + (least - 1)).alias("length"))
    listed = marks.where(F.col("kind") != SETTLED).groupBy("id", "v").agg(F.collect_list(F.struct("kind", "key", "a", "n")).alias("found"))
    texts = with_lists(rows, listed).mapInArrow(lambda b: fetch(b, least), f"key long, h2 long, id {kind}, a int, v long, segment binary")
    keyed = texts.repartition(n, "key").sortWithinPartitions("key", "id", "v", "a")
    solved = keyed.mapInArrow(lambda b: unequal(b, least, most_segments), MARK_SCHEMA.format(kind=kind))
    solved = solved.repartition(n, F.when(F.col("h2") == 0, F.xxhash64("id", "a")).otherwise(F.col("h1"))).sortWithinPartitions("h1", "h2", "id", "v", "a")
    return settled.union(solved.mapInArrow(later_stretches, f"id {kind}, v long, a int, length int"))


def with_lists(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """id, text, found and v first, then the other columns; found is null where the id and version have no list."""
    other = listed.withColumnsRenamed({"id": "other", "v": "w"})
    joined = rows.join(other, F.col("id").eqNullSafe(F.col("other")) & (F.col("v") == F.col("w")), "left")
    return joined.select("id", "text", "found", "v", *rows.columns[3:])


def marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    return with_lists(rows, marks.groupBy("id", "v").agg(F.collect_list(F.struct("a", "length")).alias("found")))


def kept_parts(b: pa.RecordBatch) -> Iterator[tuple[bytes, list[tuple[int, int]], bytes]]:
    """For each row of id, text and found: its bytes, the runs to remove, and what is left."""
    lists = b.column(2)
    first = lists.offsets.to_numpy()
    a, length = (lists.values.field(i).to_numpy() for i in range(2))
    for i, text in enumerate(strings(b.column(1))):
        raw, own = text.encode("utf-8", "surrogatepass"), slice(first[i], first[i + 1])
        spans, parts, at = cut_spans(a[own], length[own]), [], 0
        for x, y in spans:
            parts.append(raw[at:x])
            at = y
        yield raw, spans, b"".join([*parts, raw[at:]])


CUT = "n_bytes long, n_removed long, n_spans long, kept binary"


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 100, most_segments: int = 4096, hot_from: int = 64, digest: bool = False) -> DataFrame:
    """One row per input row: ``id_col``, n_bytes, n_removed, n_spans (maximal removed runs) and kept, the bytes left.

    Texts are UTF-8 bytes; null counts as empty.  Order is by id, nulls first; rows that
    share an id but not the text are documents of their own, however many, ordered by a 64-bit hash
    of the text; rows alike in both are one document and are cut alike.  Other columns aren't read; an
    empty table gives an empty result.  A text of any length is read whole, a megabyte at a time
    where anchors are found.  With ``digest`` kept_sha256 takes the place of kept.
    """
    rows, _ = plain(docs.select(id_col, text_col), id_col, text_col)
    joined = marked(rows, repeats(rows, least, most_segments, hot_from))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            out = [(len(raw), len(raw) - len(rest), len(spans), sha256(rest).hexdigest() if digest else rest) for raw, spans, rest in kept_parts(b)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary()]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"]
            return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names)

        yield from map_slices(batches, "text", work)

    schema = CUT.replace("kept binary", "kept_sha256 string") if digest else CUT
    kind = rows.schema["id"].dataType.simpleString()
    return joined.mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 100, most_segments: int = 4096, hot_from: int = 64) -> DataFrame:
    """``docs`` with all rows and columns, repeats removed from the text as by :func:`without_repeats`.

    What a cut leaves of a character is removed with it, so texts stay valid; null texts stay null.
    """
    rows, others = plain(docs, id_col, text_col)
    names = [c for c in rows.columns if c != "v"]
    left = rows.drop("v").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            shorter = [rest.decode("utf-8", "ignore") if spans else None for _, spans, rest in kept_parts(b)]
            text = pc.coalesce(pa.array(shorter, pa.string()), b.column(1).cast(pa.string()))
            return pa.RecordBatch.from_arrays([b.column(0), text, *b.columns[4:]], names)

        yield from map_slices(batches, "text", work)

    out = marked(rows, repeats(rows, least, most_segments, hot_from)).mapInArrow(run, left)
    named = out.withColumnsRenamed({"id": id_col, "text": text_col} | {f"c{i}": c for i, c in enumerate(others)})
    return named.select(*docs.columns)


def cut_spans(a: np.ndarray, length: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of marked ranges."""
    if not len(a):
        return []
    starts, stops = a.astype(np.int64), a.astype(np.int64) + length
    order = np.argsort(starts)
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > stops[:-1]]))
    return list(zip(starts[new].tolist(), stops[np.append(new[1:] - 1, len(stops) - 1)].tolist()))

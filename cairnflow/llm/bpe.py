"""BPE encoding and decoding with content-defined chunk reuse.

Method
------
1. A rolling hash over the UTF-8 bytes of a text places chunk ends where its low bits are
   zero, so the same passage is cut alike in every document that holds it.
2. A chunk is encoded once by each Python worker: its ids stay in a bounded store keyed by
   the chunk's own text, and every later document with the chunk takes them from there.
   Workers outlive tasks, so the store serves all partitions that a worker reads; what wasn't
   used for longest leaves it.
3. Chunk ends fall anywhere, also inside a word, so the ids beside a join may differ from
   those of the whole text.  The join is repaired: the text around it, from the last stretch
   of the chunk on the left to the first of that on the right, is encoded again as a whole,
   and must give exactly the ids that these stretches have in their own chunks; what lies
   between is the join's.  Stretches end at *anchors* (an ASCII space after a character that
   is no white space), where every byte-level pre-tokenizer of this family ends one piece and
   begins the next.  A chunk without two anchors belongs to the join.  Should the encodings
   not agree, the window grows to the whole text.

Tokenizers of other kinds (with a normalizer, another pre-tokenizer, or added tokens that take
in white space) may join pieces over such places, so their texts are encoded whole.

The operator reads its input once and shuffles nothing; the work follows the input's size,
and no document, however long, needs more memory than its own text and ids.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import map_slices, strings

#: White space in any regex dialect, so that an anchor is one for all of them.
WIDE_SPACE = "\\s\x1c-\x1f\x85\u180e\u200b\ufeff"
UNIT = re.compile(rf"(?<=[^{WIDE_SPACE}])(?= )")
ODD_SPACE = re.compile(rf"[{WIDE_SPACE}] ")
FIRST_ANCHOR = re.compile(rf"[^{WIDE_SPACE}] ")
ID = np.dtype("<u4")
#: Bytes of text that are encoded together.
SLICE = 8 << 20


#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Printable ASCII and Latin letters: their classes are the same in every release of Unicode and every regex library.
SETTLED = re.compile("[\x20-\x7e\n\u00bf-\u024f]*")
#: A piece that isn't such, is empty, or ends in white space, which what follows could join.
UNSETTLED = r"[^\x20-\x7e\n\x{bf}-\x{24f}]|\n\z|\A\z"


def anchored(spec: dict) -> bool:
    """Whether a tokenizer's pieces never reach over an anchor: plain byte-level, and added tokens take in no white space."""
    split = spec.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("add_prefix_space") is False and split.get("use_regex", True) is True
    return plain and not spec.get("normalizer") and spec["model"].get("type") == "BPE" and not any(t.get("lstrip") or t.get("rstrip") or re.search(r"\s", t["content"]) for t in spec["added_tokens"])


def rank_encoder(tokenizer):
    """A second encoder over the same merges, several times faster a short stretch; None where the vocabulary isn't its kind.

    It is used for stretches of SETTLED characters without added tokens alone, and only if
    the pre-tokenizer is the plain byte-level one and ids follow the order of the merges.
    """
    import json

    import tiktoken

    spec = json.loads(tokenizer.to_str())
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    wanted = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if spec.get("normalizer") or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or any(split.get(k) != v for k, v in wanted.items()):
        return None
    vocab = model["vocab"]
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    if any(vocab.get(m) != 256 + i for i, m in enumerate(merges)):
        return None
    special = {t["content"] for t in spec["added_tokens"]}
    pieces = token_bytes(tokenizer)
    ranks = {pieces[i]: i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Units:
    """Encodes many texts together, each distinct stretch between anchors once."""

    def __init__(self, tokenizer):
        self.tokenizer, self.quick = tokenizer, rank_encoder(tokenizer)
        self.lengths = np.array([len(x) for x in token_bytes(tokenizer)])
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def slow(self, stretches: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(stretches, add_special_tokens=False) if stretches else ()
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in coded]

    def words(self, pieces: pa.Array) -> pa.LargeListArray:
        """ids of each piece with a space before it."""
        unsure = pc.match_substring_regex(pieces, UNSETTLED) if self.quick else pa.array(np.ones(len(pieces), bool))
        for token in self.added if self.quick else ():
            unsure = pc.or_(unsure, pc.match_substring(pieces, token))
        sure = pieces.filter(pc.invert(unsure))
        rest = self.slow([" " + x for x in pieces.filter(unsure).to_pylist()])
        # every piece begins at an anchor of the joined text, so its ids there are its own
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(sure)], sure), " ")[0].as_py() if len(sure) else ""
        ids = np.array(self.quick.encode_ordinary(" " + joined) if len(sure) else (), dtype=ID)
        ends = np.cumsum(pc.binary_length(sure).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        count = np.zeros(len(pieces), dtype=np.int64)
        flags = unsure.to_numpy(zero_copy_only=False)
        count[~flags] = np.diff(np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1, prepend=0)
        count[flags] = [len(x) // 4 for x in rest]
        # in the order sure, unsure; the last step puts them back
        order = np.concatenate([np.flatnonzero(~flags), np.flatnonzero(flags)])
        starts = np.concatenate([[0], np.cumsum(count[order])])
        held = pa.LargeListArray.from_arrays(starts, pa.array(np.concatenate([ids, np.frombuffer(b"".join(rest), dtype=ID)])))
        back = np.empty(len(pieces), dtype=np.int64)
        back[order] = np.arange(len(pieces))
        return held.take(pa.array(back)) if flags.any() else held

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """ids of whole texts, as little-endian unsigned 32-bit."""
        odd, heads, rests = {}, [], []
        for i, t in enumerate(texts):
            head, space, rest = t.partition(" ")
            if space and ODD_SPACE.search(t):  # some spaces are no anchors
                odd[i] = UNIT.split(t)
                head, space = "", ""
            heads.append(head)
            rests.append(rest if space else None)
        pieces = pc.split_pattern(pa.array(rests, pa.string()), " ")
        coded = pc.dictionary_encode(pieces.flatten())
        taken = self.words(coded.dictionary).take(coded.indices)
        ids = taken.flatten().to_numpy().tobytes()
        ends = np.concatenate([[0], np.cumsum(taken.value_lengths().to_numpy(zero_copy_only=False))])
        at = np.concatenate([[0], np.cumsum(pc.fill_null(pieces.value_lengths(), 0).to_numpy(zero_copy_only=False))])
        at = (4 * ends[at].astype(np.int64)).tolist()
        others = list({*heads, *(u for p in odd.values() for u in p)} - {""})
        held = dict(zip(others, self.slow(others))) | {"": b""} if not self.quick else self.few(others) | {"": b""}
        out = [held[h] + ids[i:j] for h, i, j in zip(heads, at, at[1:])]
        for i, p in odd.items():
            out[i] = b"".join([held[u] for u in p])
        return out

    def few(self, stretches: list[str]) -> dict[str, bytes]:
        """ids of single stretches."""
        out, slow = {}, []
        for u in stretches:
            if SETTLED.fullmatch(u) and not any(t in u for t in self.added):
                ids = self.quick.encode_ordinary(u)
                out[u] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                slow.append(u)
        return out | dict(zip(slow, self.slow(slow)))


class Chunk:
    """A chunk's text in three parts, at its first and last anchor, with the ids of the middle and of its first and last stretch.

    Without two anchors all is head, and there are no ids.
    """

    __slots__ = ("body", "first", "head", "ids", "last", "tail")

    def __init__(self, text: str):
        self.head, self.body, self.tail, self.ids = text, "", "", None
        self.first = self.last = ("", b"")
        found = FIRST_ANCHOR.search(text)
        if found is None:
            return
        a, z = found.start() + 1, last_anchor(text, len(text))
        if a == z:
            return
        self.head, self.body, self.tail = text[:a], text[a:z], text[z:]
        second = UNIT.search(self.body, 1)
        first = self.body[: second.start()] if second else self.body
        last = self.body[last_anchor(self.body, len(self.body)) :] if second else self.body
        self.first, self.last = (first, b""), (last, b"")


def last_anchor(text: str, before: int) -> int:
    """The last anchor of a text that has one, or a text's start."""
    z = text.rfind(" ", 0, before)
    while z > 0 and not FIRST_ANCHOR.match(text, z - 1):
        z = text.rfind(" ", 0, z)
    return z


class Codec:
    """A tokenizer with a store of encoded chunks in two generations: the old one goes when the young one is full, but for what was used again."""

    def __init__(self, path: str, chunk_bytes: int = 1024, store_bytes: int = 64 << 20):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        self.anchored = anchored(spec)
        self.plain_bytes = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.units = Units(self.tokenizer) if self.anchored else None
        self.mask = np.uint32((1 << max(5, chunk_bytes.bit_length() - 1)) - 1)
        self.most_chunk = 8 * chunk_bytes
        self.young: dict[bytes, Chunk] = {}
        self.old: dict[bytes, Chunk] = {}
        self.store_bytes, self.held = store_bytes, 0
        self.widened = 0  # texts whose joins didn't agree
        self.pieces: list[bytes] | None = None

    # -- encoding -------------------------------------------------------------------------

    def cuts(self, texts: list[bytes]) -> list[list[int]]:
        """For each text the ends of its content-defined chunks, at starts of UTF-8 characters; the last is its end."""
        data = b"".join(texts)
        b = np.frombuffer(data, dtype=np.uint8)
        h = (b.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        width, power = 1, 0x01000193
        while width < 32:  # the sum over the last 2 * width bytes from two sums over width bytes
            wide = h.copy()
            wide[width:] += h[:-width] * np.uint32(power)
            h, width, power = wide, 2 * width, power * power & 0xFFFFFFFF
        at = np.flatnonzero(((h >> np.uint32(9)) & self.mask) == 0) + 1
        for _ in range(3):  # to the start of a character
            inside = at < len(b)
            inside[inside] = b[at[inside]] & 0xC0 == 0x80
            at = at + inside
        stops = np.cumsum([len(t) for t in texts])
        first = np.searchsorted(at, np.concatenate([[0], stops[:-1]]) + 32).tolist()
        past = np.searchsorted(at, stops).tolist()
        out, start = [], 0
        for i, j, stop in zip(first, past, stops.tolist()):
            ends, last = [], start
            for e in [*at[i:j].tolist(), stop]:
                while e - last > self.most_chunk:
                    last += self.most_chunk
                    while data[last] & 0xC0 == 0x80:
                        last += 1
                    ends.append(last - start)
                if e > last:
                    ends.append(e - start)
                    last = e
            out.append(ends)
            start = stop
        return out

    def whole(self, texts: list[str]) -> list[bytes]:
        """ids of texts by the library alone."""
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def encode_once(self, texts: list[str]) -> list[bytes]:
        """ids of texts without the store of chunks."""
        return self.units.encode_many(texts) if self.anchored else self.whole(texts)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """ids of whole texts as the tokenizers library gives them, each as little-endian unsigned 32-bit."""
        if not self.anchored:
            return self.whole(texts)
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        used: dict[bytes, Chunk] = {}
        fresh: list[Chunk] = []
        plans: list[list[tuple[str, Chunk | None, Chunk | None]]] = []  # of each text its joins: (window, chunk on the left, on the right)
        for data, ends in zip(raw, self.cuts(raw)):
            joins: list[tuple[str, Chunk | None, Chunk | None]] = []
            left, window, a = None, "", 0
            for z in ends:
                key = data[a:z]
                a = z
                chunk = used.get(key)
                if chunk is None:
                    chunk = used[key] = self.recalled(key, fresh)
                window += chunk.head
                if chunk.ids is not None:
                    joins.append((window + chunk.first[0], left, chunk))
                    left, window = chunk, chunk.last[0] + chunk.tail
            plans.append([*joins, (window, left, None)])
        for chunk, ids in zip(fresh, self.units.encode_many([c.body for c in fresh])):
            chunk.ids = ids
        stretches = {x for c in fresh for x in (c.first[0], c.last[0])} | {w for p in plans for w, _, _ in p}
        coded = self.units.few(list(stretches - {""})) | {"": b""}
        for chunk in fresh:
            chunk.first, chunk.last = (chunk.first[0], coded[chunk.first[0]]), (chunk.last[0], coded[chunk.last[0]])
        return [self.joined(text, joins, coded) for text, joins in zip(texts, plans)]

    def joined(self, text: str, joins: list[tuple[str, Chunk | None, Chunk | None]], coded: dict[str, bytes]) -> bytes:
        """A text's ids from those of its chunks and its windows, if these agree on the stretches that they share."""
        parts = []
        for window, left, right in joins:
            ids, before, after = coded[window], left.last[1] if left else b"", right.first[1] if right else b""
            if len(ids) < len(before) + len(after) or not ids.startswith(before) or not ids.endswith(after):
                self.widened += 1
                return self.whole([text])[0]
            parts.append(ids[len(before) : len(ids) - len(after)])
            if right:
                parts.append(right.ids)
        return b"".join(parts)

    def recalled(self, key: bytes, fresh: list[Chunk]) -> Chunk:
        """The chunk of this text from the store, or a new one, which is noted to be encoded."""
        chunk = self.young.get(key)
        if chunk is not None:
            return chunk
        chunk = self.old.pop(key, None)
        if chunk is None:
            chunk = Chunk(key.decode("utf-8", "surrogatepass"))
            if chunk.body:
                chunk.ids = b""
                fresh.append(chunk)
        self.young[key] = chunk
        self.held += 500 + 4 * len(key)  # texts, and ids, which are about as long
        if self.held > self.store_bytes // 2:
            self.old, self.young, self.held = self.young, {}, 0
        return chunk

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    # -- decoding -------------------------------------------------------------------------

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of decode(ids, skip_special_tokens=False); bytes that aren't valid UTF-8 are replaced as there."""
        if not self.plain_bytes:
            return self.tokenizer.decode(np.frombuffer(ids, dtype=ID).tolist(), skip_special_tokens=False).encode("utf-8")
        if self.pieces is None:
            self.pieces = token_bytes(self.tokenizer)
        raw = b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, dtype=ID).tolist()))
        return raw.decode("utf-8", "replace").encode("utf-8")


def token_bytes(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain}
    shown |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    out = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        out[i] = bytes(map(shown.__getitem__, token)) if all(c in shown for c in token) else token.encode()
    return out


_codecs: dict[tuple, Codec] = {}


def codec(path: str, chunk_bytes: int = 1024) -> Codec:
    """This process's codec for a vocabulary file."""
    key = (path, chunk_bytes)
    if key not in _codecs:
        _codecs[key] = Codec(path, chunk_bytes)
    return _codecs[key]


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 1024) -> DataFrame:
    """One row per input row: ``id_col``, ``ids`` (array<int>) and ``n_tokens``.

    A null text counts as empty: no ids.  Ids may be null or repeated; each row stands for
    itself.  Other columns, whatever their names, are not read.  An empty table gives an
    empty result.  A very long text is encoded whole, in chunks, in time in proportion to its
    length; rows alike give the same ids.  ``tokenizer_path`` must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path, chunk_bytes)

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            ids = [np.frombuffer(x, dtype=np.int32) for x in c.encode_many(strings(b.column(1)))]
            lengths = np.array([len(x) for x in ids], dtype=np.int64)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            return pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, flat), pa.array(lengths)], ["id", "ids", "n_tokens"])

        yield from map_slices(batches, "text", work, SLICE)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, n_tokens long").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: ``id_col`` and ``text``, the decoding of ``ids_col``; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for b in batches:
            texts = [c.decode(np.array(x if x is not None else [], dtype=ID).tobytes()).decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 1024) -> DataFrame:
    """``encode`` and ``decode`` in one pass, reduced to digests for each row.

    n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the
    decoded text in UTF-8); nulls, repeats, very long texts and empty tables as in :func:`encode`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        c = codec(tokenizer_path, chunk_bytes)
        decimal = [str(i).encode() for i in range(c.tokenizer.get_vocab_size(with_added_tokens=True))]

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            n, coded, text = [], [], []
            for ids in c.encode_many(strings(b.column(1))):
                n.append(len(ids) // 4)
                coded.append(sha256(b",".join(map(decimal.__getitem__, np.frombuffer(ids, dtype=ID).tolist()))).hexdigest())
                text.append(sha256(c.decode(ids)).hexdigest())
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(text, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

        yield from map_slices(batches, "text", work, SLICE)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)

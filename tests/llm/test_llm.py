"""The operators of cairnflow.llm on small tables: brute force, round trips, held-out accuracy, odd rows."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnflow.llm import bpe, components, embed, langid, mpeg, packing, queries, secrets, simhash, suffix, urls, warc

SMALL = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, id string, print long, found int, v double, bucket int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, ids shared by texts, and columns named as the operators name theirs."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(20_000))
    texts = [(1, None), (2, ""), (3, "  \t\n"), (4, "a"), (4, "a"), (5, "one two three"), (6, "x" * 500), (7, "x" * 500), (None, "no id here"), (None, None), (8, long), (9, long + " end"), (10, "same id"), (10, "another text of that id"), (11, "é 字 😀 \x01 <|endoftext|>    it's 123")]
    return spark.createDataFrame([(i, t, None, None, None, "z", 1, 2, 0.5, 3) for i, t in texts], ODD)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def rows_of(df, *keys):
    return sorted((tuple(r[k] for k in keys) for r in df.collect()), key=repr)


def pairs_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# -- 1: BPE -------------------------------------------------------------------------------


def test_bpe_units_and_joins_on_noise(tokenizer):
    rng = random.Random(3)
    alphabet = ["a", "B", " ", "  ", "\n", "\t", "é", "字", "1", ".", "'s", " ", " ", "\x85", "\x1c", "<|endoftext|>", "😀", "\r\n", " the", " of", "Ω", "م"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 40, 400]))) for _ in range(400)] + ["", " ", "a ", " a b\n"]
    small = bpe.Codec(queries.vocabulary(), chunk_bytes=32)
    for text, ids in zip(texts, small.encode_many(texts)):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype="<u4").tolist() == want
        assert small.decode(ids).decode() == tokenizer.decode(want, skip_special_tokens=False)


def test_bpe_chunks_are_reused():
    codec = bpe.Codec(queries.vocabulary(), chunk_bytes=64)
    shared = " ".join(f"word{i}" for i in range(300))
    codec.encode_many([f"first {shared}"])
    before = len(codec.young)
    codec.encode_many([f"second one, longer {shared}"])
    assert len(codec.young) - before <= 3


def test_bpe_store_keeps_what_is_used(tokenizer):
    """A store too small for all: what every text holds stays, ids stay right, and its size stays bounded."""
    codec = bpe.Codec(queries.vocabulary(), chunk_bytes=64, store_bytes=60_000)
    shared = " ".join(f"common{i}" for i in range(60))
    for k in range(60):
        text = f"{shared} " + " ".join(f"own{k}x{i}" for i in range(40))
        assert np.frombuffer(codec.encode(text), dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    middle = [c for c in (*codec.young.values(), *codec.old.values()) if "common30" in c.body]
    assert middle and len(codec.young) + len(codec.old) < 200


def test_bpe_joins_must_agree(tokenizer):
    """Where a stretch's ids don't come again in a join's window, the whole text is encoded."""
    codec = bpe.Codec(queries.vocabulary(), chunk_bytes=32)
    text = " ".join(f"some{i} words" for i in range(80))
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(codec.encode(text), dtype="<u4").tolist() == want and codec.widened == 0
    for chunk in codec.young.values():
        chunk.last = (chunk.last[0], chunk.last[1] + b"\1\0\0\0")
    assert np.frombuffer(codec.encode(text), dtype="<u4").tolist() == want and codec.widened == 1


def test_bpe_other_tokenizers_are_encoded_whole(tmp_path):
    """Pre-tokenizers, normalizers and added tokens that reach over spaces: the library's ids and texts all the same."""
    from tokenizers import AddedToken, Tokenizer, decoders, models, normalizers, pre_tokenizers

    letters_ = {c: i for i, c in enumerate("abcdefgh▁Ġ ")}
    merges = [("▁", "a"), ("Ġ", "a"), ("a", "b"), ("▁a", "b"), ("Ġa", "b")]
    vocab = letters_ | {"".join(m): len(letters_) + i for i, m in enumerate(merges)}
    text = " ".join(["ab a  b cab", "abc"] * 60)
    byte_level = lambda: pre_tokenizers.ByteLevel(add_prefix_space=False)
    kinds = {"metaspace": (pre_tokenizers.Metaspace(), None, decoders.Metaspace()), "prefix": (pre_tokenizers.ByteLevel(add_prefix_space=True), None, decoders.ByteLevel()), "normal": (byte_level(), normalizers.Replace("b a", "ba"), decoders.ByteLevel()), "added": (byte_level(), None, decoders.ByteLevel())}
    for name, (pre, normalizer, decoder) in kinds.items():
        made = Tokenizer(models.BPE(vocab, merges))
        made.pre_tokenizer, made.decoder = pre, decoder
        if normalizer:
            made.normalizer = normalizer
        if name == "added":
            made.add_tokens([AddedToken("b c", normalized=False), AddedToken("ca", lstrip=True, normalized=False)])
        made.save(str(tmp_path / f"{name}.json"))
        codec = bpe.Codec(str(tmp_path / f"{name}.json"), chunk_bytes=32)
        want = made.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode(text), dtype="<u4").tolist() == want, name
        assert codec.decode(np.array(want, dtype="<u4").tobytes()).decode() == made.decode(want, skip_special_tokens=False), name


def test_bpe_query(docs, odd, tokenizer, spark):
    for table in (docs, odd, odd.limit(0)):
        want = []
        for i, t in pairs_of(table):
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            want.append((i, len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
        assert rows_of(bpe.digests(table, queries.vocabulary()), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    back = bpe.decode(bpe.encode(odd, queries.vocabulary()), queries.vocabulary())
    assert rows_of(back, "doc_id", "text") == sorted(((i, t or "") for i, t in pairs_of(odd)), key=repr)


# -- 2: suffix arrays ---------------------------------------------------------------------


def brute_repeats(pairs, least=100):
    """(n_bytes, n_removed, n_spans, kept) by (id, text), documents in order of id and of their version."""
    from xxhash import xxh64_intdigest

    version = lambda t: (xxh64_intdigest(t.encode(), 42) ^ 1 << 63) - (1 << 63)  # noqa: E731  as a long
    raw = sorted({((i is not None, i or 0), version(t or ""), t or "") for i, t in pairs})
    seen, out = set(), {}
    for (known, i), _, t in raw:
        b = t.encode()
        covered = bytearray(len(b))
        for s in range(len(b) - least + 1):
            w = b[s : s + least]
            if w in seen:
                covered[s : s + least] = b"\1" * least
            seen.add(w)
        kept = bytes(c for c, m in zip(b, covered) if not m)
        spans = sum(1 for k, m in enumerate(covered) if m and (k == 0 or not covered[k - 1]))
        out[i if known else None, t] = (len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


def noisy_pairs(seed, n=60):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "é", "x"]
    passages = [" ".join(rng.choice(words) for _ in range(rng.choice([18, 25, 60]))) for _ in range(4)]
    return [(i, " ".join(rng.choice([*passages, *words, *words]) for _ in range(rng.randrange(1, 25)))) for i in range(n)]


@pytest.mark.parametrize(("most", "hot"), [(3, 1000), (4096, 16), (4096, 2)])
def test_suffix_against_brute_force(spark, docs, odd, most, hot):
    noise = spark.createDataFrame(noisy_pairs(1) + [(100 + k, f"{'filler ' * (k % 7)}{'a phrase that very many documents hold with ever other surroundings, ninety nine or more bytes long, yes'} {k} tail {k * 7}") for k in range(40)], "doc_id long, text string")
    for table in (docs, odd, noise, odd.limit(0)):
        want = brute_repeats(pairs_of(table))
        got = suffix.without_repeats(table, digest=True, most_segments=most, hot_from=hot)
        expected = sorted(((i, *want[i, t or ""]) for i, t in pairs_of(table)), key=repr)
        assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected


@pytest.mark.parametrize(("most", "hot"), [(3, 1000), (4096, 16), (4096, 2)])
def test_suffix_repeated_rows_keep_their_first_copy(spark, most, hot):
    """Rows alike in id and text are one document, in one slice of the input and in several, with copies and parts elsewhere."""
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice("alpha beta gamma delta of the x".split()) + str(rng.randrange(99)) for _ in range(n))
    own, shared, part = text(80), text(90), text(40)
    pairs = [(1, own)] * 3 + [(None, own + "!")] * 2 + [(2, shared)] * 2 + [(3, f"{text(5)} {part} {text(9)}")] * 4 + [(4, shared)] * 2 + [(k, f"{k} {part} {text(3)} {part}") for k in range(5, 30)] * 2
    rng.shuffle(pairs)
    want = brute_repeats(pairs)
    assert want[2, shared][1] == 0 and want[4, shared][1] == len(shared)
    for slices in (1, 4):
        table = spark.createDataFrame(pairs, "doc_id long, text string").repartition(slices)
        got = suffix.without_repeats(table, digest=True, most_segments=most, hot_from=hot)
        assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(((i, *want[i, t]) for i, t in pairs), key=repr)


def test_suffix_rows_without_ids(spark):
    """Thousands of texts without an id are told apart, and each has marks of its own alone."""
    rng = random.Random(13)
    parts = [" ".join(str(rng.randrange(10**6)) for _ in range(20)) for _ in range(40)]
    pairs = [(None, f"{k} {rng.choice(parts)} {rng.randrange(10**9)}") for k in range(3000)]
    table = spark.createDataFrame(pairs, "doc_id long, text string")
    want = brute_repeats(pairs)
    got = suffix.without_repeats(table, digest=True)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(((i, *want[i, t]) for i, t in pairs), key=repr)


@pytest.mark.parametrize("lengths", [(1,), (1, 4, 9)])
def test_suffix_rows_of_one_id(spark, lengths):
    """20,000 texts of one id, which 24 bits of a hash don't tell apart: each loses what it repeats, and no more."""
    rng = random.Random(17)
    parts = [" ".join(str(rng.randrange(10**6)) for _ in range(20)) for _ in range(300)]
    pairs = [(1, f"{k} " + " ".join(rng.choice(parts) if rng.random() < 0.2 else str(rng.random()) * 7 for _ in range(rng.choice(lengths)))) for k in range(20_000)]
    table = spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)
    want = brute_repeats(pairs)
    assert rows_of(suffix.without_repeats(table, digest=True), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(((i, *want[i, t]) for i, t in pairs), key=repr)
    if len(lengths) > 1:  # as the pipeline's stage
        kept = rows_of(suffix.cut(table.selectExpr("doc_id", "text", "text AS was")), "was", "text")
        assert [(w, hashlib.sha256(t.encode()).hexdigest()) for w, t in kept] == sorted(((t, want[i, t][3]) for i, t in pairs), key=repr)


def test_suffix_hot_keys_of_a_task():
    """Segments of one key are counted over slices, equal ones once; rare keys are forgotten."""
    recent = suffix.Recent(4)
    key = np.array([1, 1, 2, 3], dtype=np.int64)
    assert recent.hot(key, np.array([10, 11, 20, 30], dtype=np.int64)).tolist() == []
    assert recent.hot(key, np.array([10, 11, 21, 30], dtype=np.int64)).tolist() == []
    assert recent.hot(key, np.array([12, 13, 20, 30], dtype=np.int64)).tolist() == [1]
    for k in range(30):
        recent.hot(np.array([100 + k, 1], dtype=np.int64), np.array([k, 50 + k], dtype=np.int64))
    assert recent.keys.tolist() == [1]


def test_suffix_cut_keeps_rows(odd):
    out = suffix.cut(odd)
    assert out.columns == odd.columns
    assert out.count() == odd.count()
    assert out.where("text is null").count() == odd.where("text is null").count()


def test_maximal_repeats():
    texts = [b"xabcdabcdy", b"zabcdw"]
    data = np.frombuffer(b"\xff0".join(texts) + b"\xff1", dtype=np.uint8)
    at = np.arange(len(data))
    suffixes, common = suffix.suffix_array(data, at, 8)
    brute = sorted(at, key=lambda i: data[i:].tobytes())
    assert suffixes.tolist() == [int(i) for i in brute] or [data[i : i + 8].tobytes() for i in suffixes] == [data[i : i + 8].tobytes() for i in brute]
    left = np.concatenate([[-1], data[:-1].astype(np.int64)])
    found = {(data[suffixes[a] : suffixes[a] + n].tobytes(), tuple(sorted(suffixes[a:z].tolist()))) for a, z, n in suffix.maximal_repeats(suffixes, common, left, 3)}
    assert (b"abcd", (1, 5, 13)) in found
    assert not any(s == b"bcd" for s, _ in found)  # always after an a: not maximal


# -- 3: packing ---------------------------------------------------------------------------


def check_packed(table, packed, tokenizer):
    ids = {}
    for i, t in pairs_of(table):
        ids.setdefault(i, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])
    total = sum(len(x) for xs in ids.values() for x in xs)
    rows = packed.collect()
    assert sum(r["length"] for r in rows) == total
    sequences = {}
    for r in rows:
        piece = [x for x in ids[r["doc_id"]] if len(x) == r["doc_tokens"] and zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()) == r["ids_crc32"]]
        assert piece
        sequences.setdefault(r["sequence_id"], []).append(r)
    padding = 0
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == parts[0]["sequence_tokens"] <= 1024
        padding += parts[0]["padded_tokens"] - at
    return padding, total, len(sequences)


def test_packing(docs, odd, tokenizer):
    assert packing.pack(odd.limit(0), queries.vocabulary()).count() == 0
    check_packed(odd, packing.pack(odd, queries.vocabulary()), tokenizer)
    padding, total, n = check_packed(docs.coalesce(1), packing.pack(docs.coalesce(1), queries.vocabulary()), tokenizer)
    assert padding <= 0.01 * total + 1024


def test_differencing_balances():
    rng = np.random.default_rng(1)
    sizes = np.array([s for k in range(400) for s in packing.cut(int(rng.integers(1, 1023)), 256, k % 4 == 0)])
    window = packing.balance(sizes, 1024)
    totals = np.bincount(window, weights=sizes)
    assert totals.max() <= 1024
    assert 1 - sizes.sum() / (1024 * len(totals)) < 0.02
    two = packing.difference(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(np.bincount(two, weights=[8, 7, 6, 5, 4]).tolist()) == [14, 16]  # what the method gives by hand
    assert packing.balance(np.array([1024, 1024, 1]), 1024).max() == 2


# -- 4: embeddings ------------------------------------------------------------------------


def vectors(n=600, d=48, seed=2):
    """Unit bases, each with neighbours at cosines about the threshold, and copies."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n // 6):
        base = rng.normal(size=d)
        base /= np.linalg.norm(base)
        for c in (1.0, 0.98, 0.94, 0.91, 0.89, 1.0):
            noise = rng.normal(size=d)
            noise -= noise @ base * base
            noise /= np.linalg.norm(noise)
            out.append((c * base + math.sqrt(1 - c * c) * noise) * rng.uniform(0.5, 2))
    return [np.float32(x).tolist() for x in out]


def test_embeddings_recall_and_counts(spark):
    x = vectors()
    x[5] = list(x[0])
    rows = [(i, v, 0) for i, v in enumerate(x)] + [(9001, None, 1), (9002, [0.0] * 48, 1), (9003, [], 1), (9004, [float("nan")] * 48, 1), (9005, [1.0] * 3, 1), (None, x[0], 1), (9006, [None] + [1.0] * 47, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, count int")
    got = {r["vec_id"]: r for r in embed.near_duplicates(df).collect()}
    m = np.array(x, dtype=np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = (m @ m.T >= 0.9) & ~np.eye(len(m), dtype=bool)
    links, found = near.sum(axis=1), np.array([got[i]["n_links"] for i in range(len(m))])
    assert (found <= links).all()
    assert found.sum() >= 0.97 * links.sum()
    for i in (9001, 9002, 9003, 9004, 9005, 9006):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert (got[None]["n_links"], got[None]["kept"]) == (0, False)
    assert got[5]["component_id"] == 0
    assert embed.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_many_lengths(spark):
    """Lengths that agree in their last bits, one coordinate, minus zero, doubles."""
    long = [float(k % 7) for k in range(2051)]
    x = [long, [1.0, 0.0, 2.0], list(long), [1.0, -0.0, 2.0], [5.0], [2.0], [-2.0], [1e300, 1e300], [1e-300, 1e-300]]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed.near_duplicates(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (1, 0), 1: (1, 1), 2: (1, 0), 3: (1, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (1, 7), 8: (1, 7)}


@pytest.mark.parametrize("hashes", [1, 2, 3])
def test_embeddings_by_hashes(spark, hashes):
    """However vectors are dealt, what is found is right, and nearly all is found."""
    x = vectors(d=64, seed=3)
    got = {r["vec_id"]: r["n_links"] for r in embed.near_duplicates(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<float>"), hashes=hashes).collect()}
    m = np.array(x, dtype=np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    links = ((m @ m.T >= 0.9) & ~np.eye(len(m), dtype=bool)).sum(axis=1)
    found = np.array([got[i] for i in range(len(m))])
    assert (found <= links).all()
    assert found.sum() >= (0.97 if hashes < 3 else 0.9) * links.sum()


def shares_of(x, how):
    """What compare reads, of vectors in one process."""
    import pyarrow.compute as pc

    column = pa.array(x, pa.list_(pa.float32()))
    rows = pa.Table.from_batches(embed.dealt([pa.record_batch([pa.array(range(len(x)), pa.int64()), column], ["h", "v"])], how, "<u2", False)).sort_by("bucket")
    zero = pa.array(np.zeros(rows.num_rows, dtype=np.int32))
    side = pc.if_else(rows.column("home"), embed.HOME | embed.GUEST, embed.GUEST)
    return rows.append_column("i", zero).append_column("j", zero).append_column("side", side.cast(pa.int32())).combine_chunks().to_batches()


@pytest.mark.parametrize("noise", [0.02, 0.4])
def test_embeddings_dense_shares_find_the_same(monkeypatch, noise):
    """Cosines of all pairs, or local tables: the same links, each once, and pairs in doubt are those near the threshold."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(8, 64))
    x = [np.float32(base[k % 8] + noise * rng.normal(size=64)).tolist() for k in range(400)]
    how = (*embed.DEALING[1][:1], 1, embed.DEALING[1][1], 7)
    outs = []
    for dense in (False, True):
        if dense:
            monkeypatch.setattr(embed.Share, "candidates", embed.Share.dense)
        total, doubt = Counter(), set()
        for b in embed.compare(shares_of(x, how), how, "<u2", 0.9):
            for r in b.to_pylist():
                if r["b"] is None:
                    total[r["a"]] += r["more_a"]
                elif r["more_a"] is not None:
                    assert (key := (min(r["a"], r["b"]), max(r["a"], r["b"]))) not in doubt
                    doubt.add(key)
        outs.append((total, doubt))
    assert outs[0] == outs[1]
    m = np.array(x, dtype=float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    cosine = m @ m.T
    assert all(abs(cosine[a, b] - 0.9) < 0.03 for a, b in doubt)
    sure = (cosine >= 0.93).sum(axis=1) - 1
    assert sum(total.values()) >= 0.97 * sure.sum()


def test_embeddings_split_buckets(spark, monkeypatch):
    """One dense group, buckets split into parts: every link counted once."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=16)
    x = [np.float32(base + 0.01 * rng.normal(size=16)).tolist() for _ in range(300)]
    monkeypatch.setattr(embed, "PART", 64)
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<float>")
    got = embed.near_duplicates(df).collect()
    assert {r["n_links"] for r in got} == {299}
    assert {r["component_id"] for r in got} == {0}
    assert sum(r["kept"] for r in got) == 1


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    df = spark.createDataFrame(edges, "a long, b long")
    assert rows_of(components.components(df.repartition(7)), "node", "root") == sorted(((n, find(n)) for n in nodes), key=repr)
    assert components.components(df.limit(0)).count() == 0


# -- 5: language --------------------------------------------------------------------------


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op5_langid(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert right >= 0.97
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_odd(spark, docs, odd):
    model = langid.fit(docs)
    assert set(model) == {r[0] for r in docs.select("lang").distinct().collect()}
    got = langid.predict(odd, model).collect()
    assert len(got) == odd.count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert all(r["rejected"] == (r["lang_pred"] == "und") for r in got if r["doc_id"] in (1, 2, 3, 5))
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit(odd)).collect()} == {"und"}
    assert langid.predict(odd.limit(0), model).count() == 0
    assert langid.accepted(odd, model).columns == odd.columns
    with pytest.raises(ValueError, match="more than 2 languages"):
        langid.fit(docs, most_langs=2)


def brute_language(text, dictionaries):
    """(language, margin) by zstandard's plain interface, window by window."""
    import zstandard

    words = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
    if not any(c.isalpha() for c in words):
        return "und", 0.0
    n = len(words)
    ring = words + " "
    pieces = []
    for start in range(0, n, 512):
        pieces.append("".join(words[i] if i < n else " " if i == n else ring[(i - n - 1) % len(ring)] for i in range(start, start + 512)))
    columns = []
    for d in dictionaries.values():
        how = zstandard.ZstdCompressionParameters.from_level(6, write_content_size=0, write_dict_id=0)
        held = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=how)
        empty = len(zstandard.ZstdCompressor(level=6, write_content_size=False).compress(b""))
        columns.append([len(zstandard.ZstdCompressor(dict_data=held, compression_params=how).compress(p.encode("utf-8", "replace"))) - empty for p in pieces])
    best = min(range(len(columns)), key=lambda k: sum(columns[k]))
    margins = []
    for row in zip(*columns):
        other = min(x for k, x in enumerate(row) if k != best)
        margins.append((other - row[best]) / other)
    return list(dictionaries)[best], sum(margins) / len(margins)


def test_language_against_brute_force(spark, docs, odd):
    model = langid.fit(docs)
    for table in (docs, odd):
        got = rows_of(langid.predict(table, model).withColumn("margin", F.round("margin", 9)), "doc_id", "lang_pred", "margin", "rejected")
        want = []
        for i, t in pairs_of(table):
            lang, margin = brute_language(t or "", model)
            want.append((i, lang, round(margin, 9), lang == "und" or margin < 0.03))
        assert got == sorted(want, key=repr)


def test_language_of_texts_of_any_length(spark):
    """Texts in one language stay at every length; halves in two languages, whatever their order or length, go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    by = {}
    for r in docs.where("length(text) > 600").dropDuplicates(["text"]).orderBy("doc_id").collect():
        by.setdefault(r["lang"], []).append(r["text"])
    join = lambda lang, n: (" ".join(by[lang]) + " ") * (n // sum(map(len, by[lang])) + 1)
    lengths = (1000, 30_000, 200_000, 2_000_000)
    whole = [(lang, join(lang, n)[:n]) for lang in by for n in lengths]
    mixed = [("mixed", join(a, n)[:n] + join(b, n)[:n]) for a, b in (("en", "fr"), ("de", "es")) for n in lengths[1:]]
    table = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(whole + mixed)], "doc_id long, text string, lang string")
    got = langid.predict(table, model, keep=("lang",)).collect()
    assert all(r["rejected"] == (r["lang"] == "mixed") for r in got)
    assert all(r["lang_pred"] == r["lang"] for r in got if r["lang"] != "mixed")
    bare = spark.createDataFrame([(1, "words"), (2, "123"), (3, None)], "doc_id long, text string")
    assert [r["doc_id"] for r in langid.accepted(bare, {}).collect()] == [1]


def test_langid_short_texts_stay(spark):
    """The first words of ordinary texts: few letters are no reason to go, and most are told right."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and text is not null")
    model = langid.Classifier(langid.fit(docs))
    rows = [(langid.letters(r["text"]).split(), r["lang"]) for r in docs.select("text", "lang").collect()]
    for n, least in ((1, 0.8), (2, 0.9), (3, 0.95), (5, 0.98), (8, 0.98)):
        texts = [(" ".join(w[:n]), lang) for w, lang in rows if len(w) >= n]
        assert sum(not model.keeps(t, 0.03) for t, _ in texts) <= 0.005 * len(texts)
        assert sum(model.predict(t, 0.03)[0] == lang for t, lang in texts) >= least * len(texts)
    assert not model.keeps("12 !", 0.03) and not model.keeps("", 0.03) and model.keeps("ok", 0.03)
    short = spark.createDataFrame([(1, "ok"), (2, "..."), (3, None), (4, "Zzyzx")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in langid.accepted(short, langid.fit(docs)).collect()) == [1, 4]


# -- 6: WARC ------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = warc.derive(warc.responses(pages)).collect()
    assert len(got) == pages.count()
    html = {r["page_id"]: r for r in pages.collect()}
    for r in got:
        assert r["error"] is None and r["intact"]
        for record, own in ((r["metadata_record"], r["metadata_id"]), (r["conversion_record"], r["conversion_id"])):
            headers, block = warc.read_record(bytes(record))
            value = lambda k: warc.value_of(headers, k)  # noqa: B023,E731
            assert value("WARC-Record-ID") == own
            assert value("WARC-Refers-To") == r["response_id"]
            assert value("WARC-Target-URI") == html[r["page_id"]]["url"]
            assert value("WARC-Source-Payload-Digest") == warc.digest(html[r["page_id"]]["html"].encode())
            assert value("WARC-Source-Identified-Payload-Type") == "text/html"
            assert value("WARC-Block-Digest") == warc.digest(block)
        assert block.decode() == r["text"]
        assert "<" not in r["text"] or "&lt;" in html[r["page_id"]]["html"]
        assert "track(" not in r["text"]


def test_warc_odd(spark):
    odd = spark.createDataFrame([(1, None, None), (2, "http://a/\r\nX: y", "<p>a&amp;b<br>c</p><script>x()</script>"), (2, "http://a/", ""), (None, "u", "<title>t</title>")], "page_id long, url string, html string")
    got = warc.derive(warc.responses(odd)).orderBy("page_id", "text").collect()
    assert [r["text"] for r in got] == ["t", "", "", "a&b\nc"]
    assert got[3]["target_uri"] == "http://a/ X: y"
    foreign = spark.createDataFrame([(1, None), (2, bytearray(b"GIF89a")), (3, bytearray(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nab"))], "page_id long, record binary")
    assert [r["error"] for r in warc.derive(foreign).orderBy("page_id").collect()] == ["not a WARC record", "not a WARC record", "the block is cut short"]
    broken = warc.response("u", "x", "1", "d").replace(b"\r\n\r\nx", b"\r\n\r\ny")
    assert warc.derivatives(broken)["intact"] is False
    assert warc.derive(foreign.limit(0)).count() == 0


class Reader(HTMLParser):
    """The text of a page by the standard library's parser."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.links = [], 0, []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        self.out.append("\n" if tag in warc.BLOCKS else "")
        if tag == "a" and dict(attrs).get("href") is not None:
            self.links.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")
        self.out.append("\n" if tag in warc.BLOCKS else "")

    def handle_data(self, data):
        self.out.append("" if self.hidden else data)

    def text(self):
        lines = (re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in "".join(self.out).replace("\xa0", " ").split("\n"))
        return "\n".join(x for x in lines if x)


def test_warc_text_against_a_second_parser(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    pages += ["a<!-- <p> -->b<script>if (a<b) '</p>'</script>c<STYLE>x</style >d", "1 < 2 <br/>x<a title='>' HREF=\"u?a&amp;b\">l</a> &eacute;&nbsp;y", "<title>a &lt; b</title><p class=x>q<p>r"]
    for html in pages:
        page, plain = warc.Page(html), Reader(html)
        assert page.text() == plain.text()
        assert page.links == plain.links


def test_warc_long_pages_take_linear_time():
    for unit in ("<", "<!--", "<script ", "<script>", "<a href=\"", "<a b='", "</", "<title>", "< p ", "<!", "<p a=", "&amp;", "<a =   \""):
        start = time.time()
        warc.derivatives(warc.response("http://a/", unit * (1_000_000 // len(unit)), "1", "d"))
        assert time.time() - start < 2, unit


def test_warc_encodings_and_types():
    import gzip

    def made(head, payload, **more):
        block = b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + payload
        return warc.derivatives(warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:1>"), *more.items()], block))

    page = "<p>é</p>".encode()
    packed = gzip.compress(page)
    chunks = b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in (packed[:5], packed[5:])) + b"0\r\n\r\n"
    assert made(b"Content-Type: text/html\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked", chunks)["text"] == "é"
    assert made(b"Content-Type: text/html\r\nTransfer-Encoding: chunked", page)["text"] == "é"
    assert made(b"Content-Type: text/html; charset=latin-1", "<p>é".encode("latin-1"))["text"] == "é"
    assert made(b"Content-Type: text/html", b"<meta charset='latin-1'><p>\xe9")["text"] == "é"
    assert made(b"Content-Type: text/plain", b"a <b> &amp;")["text"] == "a <b> &amp;"
    image = made(b"Content-Type: image/png", b"\x89PNG\0")
    assert (image["text"], image["conversion_record"], image["error"]) == (None, None, None)
    headers, said = warc.read_record(image["metadata_record"])
    assert b"no-text: image/png" in said and warc.value_of(headers, "WARC-Concurrent-To") is None
    with pytest.raises(ValueError, match="isn't supported"):
        made(b"Content-Type: text/html\r\nContent-Encoding: br", b"x")
    with pytest.raises(ValueError, match="broken"):
        made(b"Content-Type: text/html\r\nContent-Encoding: gzip", packed[:-9])


def raw_deflate(data):
    c = zlib.compressobj(wbits=-15)
    return c.compress(data) + c.flush()


def test_warc_broken_cut_joined_and_empty_bodies(spark, monkeypatch):
    """Of every encoding: the whole text, or an error row; never a crash, a lost part, or an empty text without an error."""
    import gzip

    import zstandard

    first, second = b"<p>first " + b"x" * 1200, b"<p>second " + b"y" * 1200
    zstd = zstandard.ZstdCompressor()
    unsized = zstandard.ZstdCompressor(write_content_size=False)
    makers = {"gzip": [gzip.compress], "deflate": [zlib.compress, raw_deflate], "zstd": [zstd.compress, unsized.compress]}
    rows, wanted = [], []
    for name, ways in makers.items():
        for pack in ways:
            whole = pack(first)
            bodies = {"whole": whole, "joined": whole + pack(second), "padded": whole + bytes(512), "empty": b"", "cut": whole[: len(whole) // 2], "nearly": whole[:-1], "broken": whole[:3] + b"garbage garbage" + whole[9:]}
            bodies |= {"foreign": b"garbage garbage"} if name != "gzip" else {}
            for case, body in bodies.items():
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: " + name.encode() + b"\r\n\r\n" + body
                rows.append((len(rows), warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:1>")], block)))
                wanted.append({"padded": warc.plain_text(first.decode()), "whole": warc.plain_text(first.decode()), "joined": warc.plain_text((first + second).decode()), "empty": ""}.get(case))
    for r, want in zip(warc.derive(spark.createDataFrame(rows, "page_id long, record binary")).orderBy("page_id").collect(), wanted):
        assert r["text"] == want, r
        assert (r["error"] is None) == (want is not None), r
    start = time.time()  # many small streams take linear time
    assert warc.decoded(gzip.compress(b"x") * 40_000, "gzip") == b"x" * 40_000
    assert time.time() - start < 5
    monkeypatch.setattr(warc, "MOST_DECODED", 1000)
    for name, ways in makers.items():
        for pack in ways:
            with pytest.raises(ValueError, match="too long"):
                warc.decoded(pack(first), name)
            assert warc.decoded(pack(b"z" * 1000), name) == b"z" * 1000


def test_warc_brotli_where_its_library_is(monkeypatch):
    """The library's interface, by a stand-in that undoes zlib."""
    import sys
    import types

    class Stream:
        def __init__(self):
            self.stream = zlib.decompressobj()

        def process(self, piece):
            return self.stream.decompress(piece)

        def is_finished(self):
            return self.stream.eof

    monkeypatch.setitem(sys.modules, "brotli", types.SimpleNamespace(Decompressor=Stream, error=zlib.error))
    body = bytes(random.Random(1).randrange(256) for _ in range(5000))
    assert warc.decoded(zlib.compress(body), "br") == body
    for bad in (zlib.compress(body)[:-1], b"garbage"):
        with pytest.raises(ValueError, match="broken"):
            warc.decoded(bad, "br")


def test_warc_dates(spark):
    df = spark.sql("SELECT 1L AS page_id, 'u' AS url, 'x' AS html, timestamp'2020-02-03 04:05:06' AS seen UNION ALL SELECT 2L, 'u', 'x', NULL")
    got = warc.derive(warc.responses(df, date_col="seen")).orderBy("page_id").collect()
    assert [r["warc_date"] for r in got] == ["2020-02-03T04:05:06Z", "2024-01-01T00:00:00Z"]


# -- 7: SimHash ---------------------------------------------------------------------------


def brute_print(text):
    from xxhash import xxh64

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(pairs):
    prints = [(i, brute_print(t)) for i, t in pairs]
    label = {}
    distinct = sorted({p for _, p in prints})
    value = np.array(distinct, dtype=np.uint64)
    near = [np.flatnonzero(np.bitwise_count(value ^ v) <= 4) for v in value]
    low = np.array([min((i for i, p in prints if p == d and i is not None), default=10**9) for d in distinct])
    while True:
        new = np.array([low[n].min() for n in near])
        if (new == low).all():
            break
        low = new
    label = dict(zip(distinct, low.tolist()))
    return sorted(((i, format(p, "016x"), label[p] if label[p] < 10**9 else None) for i, p in prints), key=repr)


def test_simhash_against_brute_force(spark, docs, odd):
    for table in (docs, odd, odd.limit(0)):
        got = simhash.near_duplicates(table)
        assert rows_of(got, "doc_id", "fingerprint", "component_id") == brute_components(pairs_of(table))


@pytest.mark.parametrize("part", [4, 4096])
def test_simhash_finds_every_pair(spark, monkeypatch, part):
    """Random prints with others at 0 to 6 differing bits anywhere, with anchors split and whole."""
    monkeypatch.setattr(simhash, "PART", part)
    rng = random.Random(6)
    prints = []
    for _ in range(250):
        p = rng.getrandbits(64)
        prints.append(p)
        for bits in (1, 3, 4, 4, 5, 6):
            prints.append(p ^ sum(1 << b for b in rng.sample(range(64), bits)))
    value = np.array(sorted(set(prints)), dtype=np.uint64)
    df = spark.createDataFrame([(int(x),) for x in value.view(np.int64)], "print long")
    got = {r["node"]: r["root"] for r in components.components(simhash.links(df)).collect()}
    a, b = np.nonzero(np.triu(np.bitwise_count(value[:, None] ^ value[None, :]) <= 4, 1))
    label = components.roots(a, b, len(value))
    signed = value.view(np.int64).tolist()
    groups, want = {}, {}
    for k, s in enumerate(signed):
        groups.setdefault(got.get(s, s), set()).add(s)
        want.setdefault(int(label[k]), set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_covering_code():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 1 << 23, size=3000)
    at = simhash.anchors(x)
    assert (np.bitwise_count((at[:, 0] ^ x).astype(np.uint64)) <= 3).all()
    y = x ^ (1 << rng.integers(0, 23, size=3000))
    assert ((simhash.anchors(y) == at[:, :1]).any(axis=1)).all()


def test_simhash_representatives(docs, odd):
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    want = {c for _, _, c in brute_components(pairs_of(docs))}
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(want)
    assert simhash.representatives(odd).columns == odd.columns


def test_simhash_representatives_without_ids(spark):
    """One row of each component: the smallest id, and where there is none a row that the text chooses."""
    long = " ".join(f"w{i}" for i in range(400))
    other = " ".join(f"v{i}" for i in range(400))
    kept = lambda rows: rows_of(simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "text")
    assert kept([(1, long), (None, long), (None, other)]) == sorted([(1, long), (None, other)], key=repr)
    assert kept([(1, long), (None, long)]) == [(1, long)]
    assert kept([(None, long), (None, long), (None, other)]) == sorted([(None, long), (None, other)], key=repr)
    near = long + " tail"
    if np.bitwise_count(np.uint64(brute_print(long) ^ brute_print(near))) <= 4:
        assert len(kept([(None, long), (None, near)])) == 1
    assert kept([(2, long), (2, long), (2, other), (3, long)]) == sorted([(2, long), (2, other)], key=repr)
    clash = spark.createDataFrame([(1, long, 5, 6, 7), (2, long, 5, 6, 7)], "doc_id long, text string, __text int, __first int, __key int")
    assert [tuple(r) for r in simhash.representatives(clash).collect()] == [(1, long, 5, 6, 7)]


@pytest.mark.parametrize("most", [1, 10_000])
def test_lookup_of_hot_keys(spark, monkeypatch, most):
    from cairnflow.llm import common

    monkeypatch.setattr(common, "MOST_HOT", most)
    rows = spark.range(6000).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("row"))
    facts = rows.where("k <> 5000").groupBy("k").agg(F.min("row").alias("least"), F.count("*").alias("n"))
    got = common.looked_up(rows, facts, "k", 6000).orderBy("row").collect()
    assert [tuple(r) for r in got] == [(7 if i < 4000 else i, i, 0 if i < 4000 else None if i == 5000 else i) for i in range(6000)]


# -- 8: secrets ---------------------------------------------------------------------------


def entropy(w):
    return math.log2(len(w)) - sum(v * math.log2(v) for v in Counter(w).values()) / len(w)


def brute_secrets(text):
    x = text or ""
    assign = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    base = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(x) if len(m[1]) >= 8]
    base += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 32]
    more = []
    for m in re.finditer(secrets.CANDIDATE, x):
        c = m[0]
        if any(re.search(p, c) for p in secrets.ALLOW):
            continue
        for k, (kind, pattern, window, bits) in enumerate(secrets.CLASSES, len(secrets.BASE)):
            if re.search(pattern, c):
                runs = []
                for i in range(len(c) - window + 1):
                    if entropy(c[i : i + window]) >= bits - 1e-9:
                        if runs and runs[-1][1] >= i:
                            runs[-1][1] = i + window
                        else:
                            runs.append([i, i + window])
                more += [(m.start() + a, k, m.start() + z, kind) for a, z in runs]
                break
    more = [s for s in more if not any(b[0] <= s[0] and b[2] >= s[2] for b in base)]
    show = lambda spans: ",".join(f"{k}:{a}:{z}" for a, _, z, k in sorted(spans))
    return tuple(sum(b[3] == k for b in base) for k in ("assign", "access", "hex")) + (hashlib.sha256(show(base).encode()).hexdigest(), show(base + more))


def secret_texts():
    rng = random.Random(8)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    token = lambda n, a=b64: "".join(rng.choice(a) for _ in range(n))
    made = ["key " + token(40) + " end", "é😀 password='" + token(12) + "'", "token: token: abcdefgh12", "AKIA" + token(16, "ABCDEF0123") + "AKIAX", token(64, "0123456789abcdef"), token(40, "0123456789ABCDEF"), "\x01secret=\x01" + "a" * 9, "API_KEY = \"abc\" apikey:" + token(9, "ab"), "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" + token(30), "1234567890" * 4, "550e8400-e29b-41d4-a716-446655440000", "example" + token(40), "PassWord=KK" + token(9), "some-long-hyphenated-words-in-a-row/with/paths"]
    parts = ["token", "=", " ", ":", "'", '"', "AKIA", "abcdef0123456789" * 2, "secret", "X", "-", "\n", token(30), "9"]
    return made + ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(250)]


def test_secrets_against_brute_force(spark, docs, odd):
    mine = spark.createDataFrame(list(enumerate(secret_texts())), "doc_id long, text string")
    for table in (mine, docs, odd, odd.limit(0)):
        got = secrets.report(table)
        want = sorted(((i, *brute_secrets(t)) for i, t in pairs_of(table)), key=repr)
        assert rows_of(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans") == want
    assert any("entropy_base64" in r["spans"] for r in secrets.report(mine).collect())
    plan = secrets.report(docs)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_secrets_of_every_alphabet(spark):
    """Random keys of one case with digits and of mixed hexadecimal, values after an equals sign, a placeholder beside a key."""
    rng = random.Random(12)
    token = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    b64 = low + low.upper() + digits
    makes = [("entropy_lower", lambda: token(40, low + digits)), ("entropy_upper", lambda: token(40, low.upper() + "234567")), ("entropy_mixed_hex", lambda: token(40, digits + "abcdefABCDEF"))]
    makes += [("entropy_hex", lambda: "a_long_name_of_an_api_id=" + token(32, digits + "ABCDEF")), ("entropy_base64", lambda: "sample" + token(60, b64)), ("entropy_base64", lambda: token(60, b64) + "0000" + token(60, b64))]
    table = spark.createDataFrame([(k * 100 + i, make()) for k, (_, make) in enumerate(makes) for i in range(50)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.report(table).collect()}
    for k, (kind, _) in enumerate(makes):
        assert sum(f"{kind}:" in got[k * 100 + i] for i in range(50)) >= 49, kind
    plain = ["sample" + "ab1" * 4 + "example" + "cd2" * 4, "g1" * 20_000, "word" * 30 + "2024"]
    assert [r["spans"] for r in secrets.report(spark.createDataFrame([(0, t) for t in plain], "doc_id long, text string")).collect()] == [""] * 3


def test_secrets_redact(spark, odd):
    rows = spark.createDataFrame([(1, "a token = abcdefgh12 b"), (2, None), (3, "plain"), (4, "x " + "0123456789abcdef" * 2)], "doc_id long, text string")
    assert [r["text"] for r in secrets.redact(rows).orderBy("doc_id").collect()] == ["a [assign] b", None, "plain", "x [hex]"]
    assert secrets.redact(odd).columns == odd.columns
    assert secrets.redact(odd).count() == odd.count()


def test_secrets_many_in_one_text(spark):
    """Fifty thousand secrets in one text: counted and replaced in seconds, also where blocks of the text meet."""
    n = 50_000
    text = "".join(f"é token=abcdefgh{i:05d}" for i in range(n))
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string").cache()
    assert rows.count() == 1
    secrets.report(rows.limit(0)).collect()  # plans are compiled before time is taken
    start = time.time()
    assert secrets.report(rows).first()["n_assign"] == n
    assert secrets.redact(rows).first()["text"] == "é [assign]" * n
    assert time.time() - start < 20
    few = [(i, "".join(f"x{k} password: q{'z' * (k % 9)}1234567 " for k in range(700))) for i in range(2)]
    assert rows_of(secrets.report(spark.createDataFrame(few, "doc_id long, text string")), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans") == [(i, *brute_secrets(t)) for i, t in few]


def test_secrets_columns_of_any_name(spark):
    df = spark.sql("SELECT 1 AS doc_id, 'a token = abcdefgh12' AS text, 'mine' AS secrets, 2 AS candidates, 3 AS __candidates")
    assert tuple(secrets.redact(df).first()) == (1, "a [assign]", "mine", 2, 3)


# -- 9: URLs ------------------------------------------------------------------------------


def test_urls_odd_and_brute_force(spark):
    urls_ = [None, "", "nothing", "http://", "http://EXAMPLE.com", "http://example.com/", "https://a.example.com/en/x", "https://www.example.com/en/", "https://x.www.example.com/en/?q", "http://net/fr/", "http://badnet/fr/", "http://a.net/fr", "http://a.net:80/fr/", "ftp://h.com#f", "http://h.com?x=/en/", "://com/x", "http://.com/", "http://example.com/en"]
    rules = [*queries.URL_RULES, ("block", "h.com", "/a"), ("allow", "h.com", "/ab/c"), ("block", "", "/bad/")]
    urls_ += ["http://h.com/abc", "http://h.com/ab/cd", "http://h.com/ab/", "http://q/bad/1", "http://h.com/bad/1"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls_)] + [(None, "http://a.com/", "y")], "page_id long, url string, host string")

    def want(u):
        host, path = urls.parts(u)
        fits = [(len(h.split(".")) if h else 0, len(p), h + p, v) for v, h, p in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[2], best[3] if best else "allow"

    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge(df, rules).collect()}
    for i, u in enumerate(urls_):
        assert got[i] == want(u), u
    assert urls.judge(df.limit(0), rules).count() == 0
    with pytest.raises(ValueError, match="bound"):
        urls.judge(df, rules, most_bytes=10)


def test_urls_long():
    trie = urls.Trie(queries.URL_RULES)
    start = time.time()
    for host, path in (("a.com", "/" + "x" * 1_000_000), ("a." * 500_000 + "net", "/es/" + "y/" * 500_000), ("x" * 1_000_000, "/")):
        trie.find(*urls.parts(f"http://{host}{path}"))
    assert time.time() - start < 2


# -- 10: MPEG audio -----------------------------------------------------------------------


def test_mpeg_round_trip(docs, odd):
    for table in (docs, odd):
        want = []
        for i, t in pairs_of(table):
            raw = (t or "").encode()
            padded = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
            want.append((i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])))
        assert rows_of(mpeg.digests(table), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(want, key=repr)
    parsed = mpeg.parse_column(mpeg.encode_column(odd)).collect()
    assert all(r["crc_bad"] == 0 and r["skipped_bytes"] == 0 and r["frames"] == len(r["seek_offsets"]) for r in parsed)
    assert mpeg.digests(odd.limit(0)).count() == 0


def test_mpeg_resync_and_checksums():
    payload = bytes(range(256)) * 9
    media = mpeg.store(payload)
    s = mpeg.parse(media)
    assert (s.frames, s.samples, s.duration, s.checked, s.bad) == (4, 4608, mpeg.Fraction(96, 1000), 4, 0)
    assert mpeg.read_back(media, s) == payload
    assert s.table["frames"] == 4 and s.tags == {"TLEN": "96"}
    assert s.seek(mpeg.Fraction(25, 1000)) == s.offsets[1]
    assert s.seek(mpeg.Fraction(1)) is None
    noisy = media[: s.offsets[1]] + b"\xff\xfb junk \xff\xfa\xc4\xc0" + media[s.offsets[1] :] + b"TAG" + bytes(125)
    n = mpeg.parse(noisy)
    assert (n.frames, n.skipped) == (4, 12)
    assert mpeg.read_back(noisy, n) == payload
    broken = bytearray(media)
    broken[s.offsets[2] + 7] ^= 1
    assert mpeg.parse(bytes(broken)).bad == 1
    assert mpeg.parse(b"").frames == mpeg.parse(b"no audio at all").frames == 0
    assert mpeg.header(bytes([0xFF, 0xFB, 0x90, 0x00]), 0).size == 417
    assert mpeg.header(bytes([0xFF, 0xFD, 0xA4, 0x00]), 0).samples == 1152


def test_mpeg_text_that_looks_like_a_tag(spark):
    """TAG at byte 521 of the last unit is 128 bytes from the end, where an ID3v1 tag would begin."""
    text = "x" * 521 + "TAG" + "x" * 52
    for payload in (text.encode(), b"y" * 1152 + text.encode()):
        media = mpeg.store(payload)
        for tag in (b"", b"TAG" + bytes(125)):
            s = mpeg.parse(media + tag)
            assert (s.frames, s.skipped, s.bad) == (len(payload) // 576, 0, 0)
            assert mpeg.read_back(media + tag, s) == payload
        for short in (1, 100, 300):  # a last frame that is cut off, then a tag
            assert mpeg.parse(media[:-short] + b"TAG" + bytes(125)).frames == len(payload) // 576 - 1
    got = mpeg.digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got["payload_bytes"], got["payload_sha256"]) == (576, hashlib.sha256(text.encode()).hexdigest())


def plain_feature(media):
    """(payload, feature) of a stored stream by a second, plain walk over its tag, table and frames."""
    assert media[:3] == b"ID3"
    at = 10 + sum((media[6 + k] & 127) << (21 - 7 * k) for k in range(4))
    assert media[10:14] == b"TLEN"
    length = media[21 : 20 + int.from_bytes(media[14:18], "big")].decode()
    payload, offsets, good, table = b"", [], 0, ""
    while at < len(media):
        frame = media[at : at + 672]
        assert frame[:4] == b"\xff\xfa\xc4\xc0" and len(frame) == 672
        if frame[23:27] == b"Info":
            table = f"Info:{int.from_bytes(frame[31:35], 'big')}:{int.from_bytes(frame[35:39], 'big')}"
        else:
            offsets.append(at)
            payload += frame[23 : 23 + 576]
            crc = 0xFFFF
            for byte in frame[2:4] + frame[6:23]:
                for k in range(7, -1, -1):
                    crc = (crc << 1) ^ (0x18005 if (crc >> 15 ^ byte >> k) & 1 else 0)
            good += crc & 0xFFFF == int.from_bytes(frame[4:6], "big")
        at += 672
    n = len(offsets)
    d = mpeg.Fraction(1152 * n, 48000)
    seek = str(offsets[0]) + (f"+672*{n - 1}" if n > 1 else "")
    return payload, f"mpeg1-layer3;48000Hz;1ch;224000bps;frames={n};samples={1152 * n};duration={d.numerator}/{d.denominator};table={table};crc={good}/{n};skipped=0;seek={seek};tags=TLEN={length}"


def test_mpeg_against_a_second_parser(spark, docs, odd):
    tags = ["x" * o + word + "y" * (576 - o - len(word)) for o in range(573) for word in ("TAG", "ID3")]
    tagged = spark.createDataFrame(list(enumerate(["z" * 576 * (i % 3) + t for i, t in enumerate(tags)])), "doc_id long, text string")
    for table in (docs, odd, tagged):
        media = [bytes(r["media"]) for r in mpeg.encode_column(table).collect()]
        got = [tuple(r)[1:] for r in mpeg.digests(table).collect()]
        for (_, text), m, row in zip(pairs_of(table), media, got):
            raw = (text or "").encode()
            payload, feature = plain_feature(m)
            assert payload == raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
            assert row == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature)


def bits_crc(bits):
    crc = 0xFFFF
    for b in bits:
        crc = ((crc << 1) ^ (0x8005 if (crc >> 15) ^ int(b) else 0)) & 0xFFFF
    return crc


@pytest.mark.parametrize(("second", "third", "mode", "layer", "allocations", "selectors"), [
    (0xFE, 0x44, 0x00, 1, [4] * 64, False),  # layer I, two channels
    (0xFE, 0x44, 0xC0, 1, [4] * 32, False),  # one channel
    (0xFE, 0x44, 0x50, 1, [4] * (16 + 24), False),  # joint, apart in 8 subbands
    (0xFC, 0xA4, 0x00, 2, [b for n, b in ((11, 4), (12, 3), (4, 2)) for _ in range(2 * n)], True),  # layer II, 192 kbit/s at 48 kHz
    (0xFC, 0xA0, 0xC0, 2, [b for n, b in ((11, 4), (12, 3), (7, 2)) for _ in range(n)], True),  # 44.1 kHz, one channel
    (0xFC, 0x14, 0xC0, 2, [b for n, b in ((2, 4), (6, 3)) for _ in range(n)], True),  # 32 kbit/s
    (0xF4, 0x44, 0xC0, 2, [b for n, b in ((4, 4), (7, 3), (19, 2)) for _ in range(n)], True),  # version 2
])
def test_mpeg_checksums_of_layers_one_and_two(second, third, mode, layer, allocations, selectors):
    rng = random.Random(9)
    head = bytes([0xFF, second, third, mode])
    h = mpeg.header(head + bytes(8), 0)
    assert (h.layer, h.protected) == (layer, True)
    stream = b""
    for _ in range(3):
        values = [rng.randrange(1 << b) for b in allocations]
        bits = "".join(format(v, f"0{b}b") for v, b in zip(values, allocations))
        covered = bits + ("".join(rng.choice("01") for _ in range(2 * sum(map(bool, values)))) if selectors else "")
        body = "".join(rng.choice("01") for _ in range(8 * (h.size - 6) - len(covered)))
        stream += head + bits_crc(format(int.from_bytes(head[2:], "big"), "016b") + covered).to_bytes(2, "big") + int(covered + body, 2).to_bytes(h.size - 6, "big")
    s = mpeg.parse(stream)
    assert (s.frames, s.checked, s.bad, s.skipped) == (3, 3, 0, 0)
    broken = bytearray(stream)
    broken[h.size + 7] ^= 16
    assert mpeg.parse(bytes(broken)).bad == 1


def test_mpeg_tags_and_tables():
    old = b"ID3\x02\0\0\0\0\0\x0e" + b"TT2\0\0\x05\0Song" + bytes(3)
    media = mpeg.store(bytes(1152))
    end = b"TAG" + b"Title".ljust(30, b"\0") + b"Artist".ljust(30) + bytes(30) + b"1999" + b"note".ljust(28, b"\0") + b"\0\x05\x11"
    s = mpeg.parse(old + media + end)
    assert s.tags == {"TT2": "Song", "TLEN": "48", "v1.title": "Title", "v1.artist": "Artist", "v1.year": "1999", "v1.comment": "note", "v1.track": "5", "v1.genre": "17"}
    assert (s.frames, s.skipped) == (2, 0)
    frame = bytearray(media[-672:])
    vbri = frame[:36] + b"VBRI" + bytes(6) + (1344).to_bytes(4, "big") + (2).to_bytes(4, "big") + b"\0\x02\0\x01\0\x02\0\x01" + b"\x02\xa0\x02\xa0"
    t = mpeg.parse(bytes(vbri.ljust(672, b"\0") + frame * 2)).table
    assert (t["kind"], t["frames"], t["bytes"], t["toc"]) == ("VBRI", 2, 1344, [672, 672])
    # a header alone that no agreeing one follows is no frame
    lone = b"\xff\xfb\x90\x00" + bytes(413) + b"\xff\xf3\x90\x00" + bytes(100)
    assert mpeg.parse(lone + media[-1344:]).frames == 2


# -- the pipeline -------------------------------------------------------------------------


def test_pipeline(spark, docs):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    frame = docs
    model = langid.fit(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = frame
        frame = spark.createDataFrame(stage(spark, before, SMALL).toPandas(), docs.schema)
        assert frame.columns == docs.columns
        if name == "language":
            told = {t: brute_language(t or "", model) for _, t in pairs_of(before)}
            assert sorted(i for i, _ in pairs_of(frame)) == sorted(i for i, t in pairs_of(before) if told[t][0] != "und" and told[t][1] >= 0.03)
        if name == "near_duplicates":
            assert sorted(i for i, _ in pairs_of(frame)) == sorted({c for _, _, c in brute_components(pairs_of(before))})
        if name == "repeated_passages":
            cut = brute_repeats(pairs_of(before))
            assert frame.count() == before.count()
            left = dict(pairs_of(frame))
            assert all(len(left[i].encode()) in range(n - gone - 8, n - gone + 1) for (i, _), (n, gone, _, _) in cut.items())
        if name == "secrets":
            dirty = {i for i, t in pairs_of(before) if brute_secrets(t)[4]}
            same = dict(pairs_of(before))
            assert all((t != same[i]) == (i in dirty) for i, t in pairs_of(frame))
    run = corpus_pipeline.run(spark, SMALL)
    assert run.agg(F.sum("length")).first()[0] == packing.pack(frame, queries.vocabulary()).agg(F.sum("length")).first()[0]


def test_pipeline_stages_on_odd_and_empty_tables(spark, docs, odd):
    """Row by row what each row-keeping stage leaves of the odd table, and nothing from an empty one."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0, name
    rows = pairs_of(odd)
    kept = rows_of(stages["language"](spark, odd, SMALL), "doc_id", "text")
    assert kept == sorted(((i, t) for i, t in rows if t and any(c.isalpha() for c in t)), key=repr)  # no labels, so letters tell
    label = {i: c for i, _, c in brute_components(rows)}
    near = rows_of(stages["near_duplicates"](spark, odd, SMALL), "doc_id", "text")
    prints = {t: p for (_, t), p in zip(rows, (brute_print(t) for _, t in rows))}
    assert len({prints[t] for _, t in near}) == len(near) and {i for i, _ in near} <= set(label)
    cut = brute_repeats(rows)
    passages = stages["repeated_passages"](spark, odd, SMALL)
    assert rows_of(passages.where("text is null"), "doc_id") == rows_of(odd.where("text is null"), "doc_id")
    assert sorted(len((t or "").encode()) for _, t in pairs_of(passages)) == sorted(n - gone for n, gone, _, _ in (cut[i, t or ""] for i, t in rows))
    assert rows_of(stages["secrets"](spark, odd, SMALL), "doc_id", "text") == sorted(rows, key=repr)


def test_queries_are_registered():
    names = [f"op{n}_" for n in range(1, 14)]
    assert [n for n in names if not any(q.startswith(n) for q in queries.queries())] == []
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert pa.__version__


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("embeddings", "pages", "documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = queries.queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want.select(", ".join(columns)).fetchall(), key=repr)

"""Each operator against brute force, and on nulls, empty tables, ties, repeats, long texts and clashing columns."""

import base64
import ctypes
import gc
import hashlib
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import ann, decontam, packing, quality, simhash, simhash_similarity, substring, tokencount, toxicity, warc
from sparkloom.llm.common import free_shuffles
from sparkloom.llm.components import connected_components
from sparkloom.llm.tokenization import default_path, encoder, version_digest

WHITE = " \t\n\x0b\f\r"


def split(text):
    out, word = [], ""
    for c in text or "":
        if c in WHITE:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return [*out, word] if word else out


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with every oddity, and columns whose names the operators use themselves."""
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "x y", "Ünï", "<|endoftext|>"]
    base = [" ".join(r.choices(vocabulary, k=r.choice([1, 2, 3, 60, 200]))) for _ in range(40)]
    shared = " ".join(f"s{i}" for i in range(70))
    texts = [*base, base[5], base[5].upper(), None, "", "   \n", "one", shared, f"a b {shared} c", f"{base[7]} {shared}", " ".join(r.choices(vocabulary, k=30_000)), f"{base[9]}\t{base[9]}"]
    rows = [(i, t, f"l{i % 3}") for i, t in enumerate(texts)]
    rows += [(3, base[3], "again"), (3, base[3], "again"), (None, base[4], "no id"), (None, None, "nothing")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.select("*", F.lit(1).alias("fp"), F.lit("x").alias("row"), F.lit(2).alias("own"), F.lit(3).alias("length"), F.lit("y").alias("content"), F.lit(4).alias("score"), F.lit("z").alias("_1 odd.name")).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_every_document_operator_takes_an_empty_table(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash_similarity.near_duplicates(empty).count() == 0
    assert substring.remove_repeats(empty).count() == 0
    assert tokencount.count_tokens(empty).count() == 0
    assert quality.classify(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert decontam.contaminated(empty, benchmark).count() == 0


# SimHash


def slow_fingerprint(text):
    words = split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(keys, linked):
    label = list(keys)
    for _ in keys:
        for i in range(len(keys)):
            label[i] = min([label[j] for j in range(len(keys)) if linked(i, j)])
    return label


def test_simhash_against_brute_force(odd):
    rows = simhash.near_duplicates(odd).collect()
    source = odd.select("doc_id", "text").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fp % 2**64) for r in rows) == sorted((s.doc_id is None, s.doc_id or 0, slow_fingerprint(s.text)) for s in source)
    known = [(s.doc_id, slow_fingerprint(s.text)) for s in source if s.doc_id is not None]
    label = components([k for k, _ in known], lambda i, j: (known[i][1] ^ known[j][1]).bit_count() <= 2)
    expected = dict(zip([k for k, _ in known], label, strict=True))
    assert all(r.component_id == expected.get(r.doc_id) for r in rows)


@pytest.mark.parametrize("max_bits, cell", [(0, 2048), (1, 2048), (2, 2048), (2, 3), (1, 3), (3, 2048)])
def test_simhash_links_all_near_fingerprints(spark, max_bits, cell):
    r = random.Random(max_bits)
    words = set()
    for _ in range(60 if max_bits < 3 else 12):
        w = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 3, 30])):
            words.add(w)
            for b in r.sample(range(64), r.choice([1, 2, 3])):
                w ^= 1 << b
    words |= {0, 1, 3, 1 << 63, (1 << 64) - 1, (1 << 64) - 2}
    listed = sorted(words)
    cells = simhash.embedding(np.array(listed, np.uint64)).view(np.int64).tolist()
    signed = np.array(listed, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame(list(zip(signed, cells, range(len(listed)), strict=True)), "fp long, cell long, node long")
    found = {x.node: x.component for x in connected_components(simhash.links(nodes, max_bits, cell)).collect()}
    label = components(list(range(len(listed))), lambda i, j: (listed[i] ^ listed[j]).bit_count() <= max_bits)
    assert [found.get(i, i) for i in range(len(listed))] == label


@pytest.mark.parametrize("measure", simhash_similarity.MEASURES)
def test_similarity_links_against_brute_force(spark, odd, measure):
    r = random.Random(9)
    rows, n = [], 1000
    for _ in range(25):
        words = [f"v{r.randrange(5000)}" for _ in range(r.choice([12, 40, 90, 300, 1200]))]
        for share in (0, 0.002, 0.01, 0.03, 0.08):
            rows.append((n, " ".join(f"v{r.randrange(5000)}" if r.random() < share else w for w in words)))
            n += 1
    df = odd.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    docs = df.distinct().where("doc_id is not null").collect()

    def shingles(text):
        words = split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(d.text) for d in docs]

    def alike(i, j):
        common, p, q = len(sets[i] & sets[j]), len(sets[i]), len(sets[j])
        if not p or not q:
            return p == q
        return common**2 >= 0.64 * p * q - 1e-9 if measure == "cosine" else common >= 0.8 * (p + q - common) - 1e-9

    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if label[i] != label[j] and alike(i, j):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    least = {}
    for d, x in zip(docs, label, strict=True):
        least[x] = min(least.get(x, d.doc_id), d.doc_id)
    expected = {d.doc_id: least[x] for d, x in zip(docs, label, strict=True)}
    found = simhash_similarity.near_duplicates(df, measure=measure).collect()
    assert len(found) == df.count()
    assert {x.doc_id: x.component_id for x in found} == expected | {None: None}


def test_similar_texts_share_a_key_at_every_length():
    r = np.random.default_rng(3)
    for n in (4, 5, 8, 12, 16, 36, 76, 190, 300, 1200):  # shingles; as many are added as a cosine of 0.8 allows
        for _ in range(100):
            a = r.integers(0, 1 << 64, n, np.uint64)
            b = np.concatenate([a, r.integers(0, 1 << 64, n * 9 // 16, np.uint64)])
            assert set(simhash_similarity.band_keys(a)) & set(simhash_similarity.band_keys(b))


@pytest.mark.parametrize("base", [True, False])
def test_similar_groups_whose_base_has_a_middle_id(spark, base):
    r = random.Random(4)
    words = [r.randbytes(4).hex() for _ in range(244)]
    rows = [(1000, " ".join(words))] if base else []
    for i in range(300):  # without the base a few close pairs chain some
        w = list(words)
        start = r.randrange(50)
        for k in range(9):  # 45 of 240 shingles: a cosine of 0.81 to the base, most pairs about 0.7
            w[start // 2 + 25 * k] = r.randbytes(4).hex()
        rows.append((850 + i + (i >= 150), " ".join(w)))
    sets = [set(simhash_similarity.shingle_hashes(t.encode(), 5).tolist()) for _, t in rows]
    near = np.array([[len(a & b) >= 0.8 * (len(a) * len(b)) ** 0.5 - 1e-9 for b in sets] for a in sets])
    label = np.array([i for i, _ in rows])
    for _ in rows:
        label = np.where(near, label, 1 << 40).min(axis=1)
    found = simhash_similarity.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in found} == dict(zip([i for i, _ in rows], label.tolist(), strict=True))


def test_block_links_find_what_hubs_miss():
    r = np.random.default_rng(6)
    base = r.integers(0, 1 << 64, 240, np.uint64)
    sets = [np.unique(np.concatenate([base[: 240 - 40], r.integers(0, 1 << 64, 40, np.uint64)])) for _ in range(3)] + [r.integers(0, 1 << 64, 50, np.uint64)]
    assert len(simhash_similarity.block_links(sets, [0, 1, 2, 3], 0.8)) == 2
    assert simhash_similarity.block_links(sets, [0, 0, 0, 3], 0.8) == []


def test_embedding_distance_is_a_lower_bound():
    r = np.random.default_rng(1)
    a, b = (r.integers(0, 1 << 64, 500, np.uint64) for _ in range(2))
    counts = lambda x: np.stack([(simhash.embedding(x) >> np.uint64(2 * i)) & np.uint64(3) for i in range(32)]).astype(int)
    assert (np.abs(counts(a) - counts(b)).sum(axis=0) <= np.bitwise_count(a ^ b)).all()


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 300)] + [(5, 5), (None, 3)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {i: 7 for i in (7, *range(200, 300))}


# Substring dedup


def slow_removal(docs, window):
    words = [split(t) for _, t in docs]
    first = {}
    for (i, _), w in zip(docs, words, strict=True):
        for s in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[s : s + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        keep = [True] * len(w)
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                keep[s : s + window] = [False] * window
        out.append((i, len(w), keep.count(False), " ".join(x for x, k in zip(w, keep, strict=True) if k)))
    return out


@pytest.mark.parametrize("window, gram, bits", [(50, 20, None), (50, 20, 8), (5, 3, 20), (3, 3, 22), (1, 1, 20)])
def test_substring_against_brute_force(odd, window, gram, bits):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    found = substring.remove_repeats(odd, window, gram, bits).collect()
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, found), key=order) == sorted(slow_removal(docs, window), key=order)


def test_substring_carries_columns(odd):
    found = substring.remove_repeats(odd, carry=("lang", "row", "_1 odd.name"))
    assert found.select("row.`_1 odd.name`", "row.row").distinct().collect() == [("z", "x")] and found.count() == odd.count()


def thue_morse(n, a, b):
    return "".join((a, b)[x.bit_count() & 1] for x in range(n))


def test_different_windows_are_never_equal(spark):
    """Words and windows that polynomials modulo 2^64 can't tell apart, whatever the base."""
    r = random.Random(3)
    other = [f"p{r.randrange(999)}" for _ in range(40)]
    rows = [(i, " ".join([*other[:20], thue_morse(1024, *ab), *other[20:], "end", *other[:10]])) for i, ab in enumerate(("ab", "ba"))]
    rows += [(i + 2, thue_morse(2048, *ab)) for i, ab in enumerate((("x ", "y "), ("y ", "x ")))]
    found = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found)) == sorted(slow_removal(rows, 50))


def test_sketch_follows_the_input(spark, odd, empty):
    assert substring.sized(empty) == substring.sized(spark.createDataFrame([(1, None)], "doc_id long, text string")) == substring.LEAST_BITS
    some, more = (substring.sized(odd.select(F.repeat("text", n).alias("text"))) for n in (1000, 4000))
    assert substring.LEAST_BITS < some == more - 2


# Nearest neighbours


@pytest.mark.parametrize("n, k", [(3000, 10), (7, 10), (200, 1)])
def test_nearest_against_brute_force(spark, n, k):
    r = np.random.default_rng(n)
    x = np.float32(r.normal(0, 1, (n, 16)) * r.choice([0.01, 1, 1000], (n, 1)))
    x[n // 2 :: 3] = x[0]  # a vector that a sixth of all rows have
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    odd_rows = [(None, x[0].tolist(), "c"), (n + 1, None, "c"), (n + 2, [], "c"), (n + 3, [0.0] * 16, "c"), (n + 4, [float("nan")] * 16, "c"), (n + 5, [1.0, None] * 8, "c"), (n + 6, [float("inf")] * 16, "c"), (n + 7, [1.0] * 3, "c")]
    df = spark.createDataFrame(rows + odd_rows, "vec_id long, embedding array<float>, c_ids string")
    found = defaultdict(list)
    for row in ann.nearest(df, df.where("vec_id % 50 = 0"), k).orderBy("query_id", "rank").collect():
        found[row.query_id].append((row.rank, row.vec_id, row.score))
    y = x.astype(np.float64)
    for q in range(0, n, 50):
        d = np.zeros(n)
        for j in range(16):
            d += (y[:, j] - y[q, j]) ** 2
        d = np.sqrt(d)
        best = [i for i in np.lexsort((np.arange(n), d)).tolist() if i != q][:k]
        assert found[q] == [(j + 1, i, d[i]) for j, i in enumerate(best)]


def test_nearest_without_candidates(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert ann.nearest(df, df).count() == 0


def kinds_of_vectors(r, n, dim):
    hot = np.eye(dim)[r.integers(0, dim, n)]
    yield "normal", r.normal(0, 1, (n, dim))
    yield "one-hot", hot
    yield "nearly one-hot", hot + r.normal(0, 1, (n, dim)) * 10.0 ** r.uniform(-12, -6, (n, 1))
    yield "sparse", np.where(r.random((n, dim)) < 0.1, r.integers(-3, 4, (n, dim)), 0).astype(float) + hot
    yield "near-equal", r.normal(0, 1, dim) + r.normal(0, 1, (n, dim)) * 10.0 ** r.uniform(-14, -3, (n, 1))
    yield "huge", r.normal(0, 1, (n, dim)) * 10.0 ** r.uniform(100, 300, (n, 1))
    yield "tiny", r.normal(0, 1, (n, dim)) * 10.0 ** r.uniform(-320, -100, (n, 1)) + 5e-324
    yield "mixed", r.normal(0, 1, (n, dim)) * 10.0 ** r.uniform(-30, 30, (n, 1))


@pytest.mark.parametrize("dim", [1, 3, 24, 64, 1100])
def test_bounds_hold(dim):
    r = np.random.default_rng(dim)
    for name, x in kinds_of_vectors(r, 120, dim):
        side = {"ids": np.arange(len(x)), **dict(zip(("codes", "scale", "error"), ann.quantise(x), strict=True))}
        lower, upper = ann.bounds(side, side)
        exact = np.array([ann.distances(np.broadcast_to(a, x.shape), x) for a in x])
        assert (lower <= exact).all() and (exact <= upper).all(), name
        assert np.abs(side["codes"]).max() <= 127


@pytest.mark.parametrize("k", [1, 3])
def test_candidates_keep_the_nearest(k):
    r = np.random.default_rng(k)
    for name, x in kinds_of_vectors(r, 300, 16):
        side = {"ids": np.arange(300), **dict(zip(("codes", "scale", "error"), ann.quantise(x), strict=True))}
        part = lambda at: {c: v[at] for c, v in side.items()}  # noqa: E731,B023
        found = ann.Candidates(k)
        for s in range(0, 300, 70):
            found.tiles(part(slice(0, 40)), part(slice(s, s + 70)))
        q, c, _, _ = found.prune()
        for i in range(40):
            d = ann.distances(np.broadcast_to(x[i], x.shape), x)
            best = [j for j in np.lexsort((np.arange(300), d)).tolist() if j != i][:k]
            assert set(best) <= set(c[q == i].tolist()), name


def test_nearest_serves_every_length_of_vectors(spark):
    r = np.random.default_rng(2)
    x = {i: r.normal(0, 1, 2 if i % 3 else 3).tolist() for i in range(0, 1000, 4)} | {7: [1.0], 100: [1.0, 2.0, 3.0], 500: [0.5]}
    rows = [(i, v) for i, v in x.items()] + [(100, [9.0, 9.0, 9.0]), (8, x[8]), (8, x[8])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for row in ann.nearest(df, df.where("vec_id % 100 = 0"), 5).orderBy("query_id", "rank").collect():
        found[row.query_id].append((row.vec_id, row.score))
    for q in range(0, 1000, 100):
        near = sorted((float(ann.distances(np.array([v]), np.array([x[q]]))[0]), i) for i, v in rows if i != q and len(v) == len(x[q]))[:5]
        assert found[q] == [(i, d) for d, i in near]


# WARC


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://e.example/{i}", h) for i, h in enumerate(["<p>a</p>", "<p>b</p>", "<p>a</p>", "", None, "é" * 50_000, "WARC/1.1\r\n\r\n", "<p>a</p>"])]
    return spark.createDataFrame([*rows, (1, "again", "<p>b</p>"), (None, None, "<p>b</p>"), (None, "u", "only here"), (40, "line\r\nbreak é", "z")], "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit(2))


def test_warc_round_trip(pages):
    source = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for i, p in source:
        if i is not None:
            first[p] = min(first.get(p, i), i)
    expected = []
    for i, p in source:
        to = None if i == first.get(p) else first.get(p)
        expected.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if to is None else "revisit", to, p if to is None else None))
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in warc.archive_round_trip(pages).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_warc_with_more_repeated_payloads_than_are_broadcast(pages, monkeypatch):
    order = lambda rows: sorted(map(str, rows))
    whole = order(warc.archive_round_trip(pages).collect())
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert order(warc.archive_round_trip(pages).collect()) == whole


def test_warc_least_bytes_and_empty(spark, pages):
    found = warc.archive_round_trip(pages, least_bytes=10**6).collect()
    assert {r.record_type for r in found} == {"response"}
    assert warc.archive_round_trip(pages.where("false")).count() == 0


def test_normaliser_rewrites_a_monolithic_stream(tmp_path):
    import pyarrow.fs as pafs

    records = [warc.record(i, f"http://e/{i}", bytes([65 + i % 26]) * (i * 977 % 5000), None) for i in range(200)]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    (tmp_path / "a.warc.gz").write_bytes(pack.compress(b"".join(records)) + pack.flush())
    path, index, n = warc.normalise_file(pafs.LocalFileSystem(), str(tmp_path / "a.warc.gz"))
    assert n == 200
    back = list(warc.read_members(pafs.LocalFileSystem(), path, index))
    assert [int(h["page-id"]) for h, _ in back] == list(range(200))
    assert all(b.endswith(bytes([65 + i % 26]) * (i * 977 % 5000)) for i, (_, b) in enumerate(back))


def test_truncated_archives_are_errors():
    whole = warc.record(1, "u", b"payload", None)
    with pytest.raises(ValueError):
        list(warc.split_records(iter((whole[:-9], b"")).__next__))


# Tokens


def library_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(default_path()).encode_batch(texts, add_special_tokens=False)]


def test_encoder_gives_the_librarys_ids():
    r = random.Random(2)
    alphabet = list("abcXYZ 019  \n\t é漢字🙂ñ'’.,!?-_/\\<|>‍́ \x00\x1c\x85") + ["<|endoftext|>", " <|endoftext|> ", "'s", "'ll", "   ", "\r\n", "ſ", "﻿", "Ⅷ", "²"]
    texts = ["".join(r.choices(alphabet, k=r.choice([0, 1, 5, 60, 300]))) for _ in range(1500)] + ["a" * 5000, " " * 3000, "<|endoftext|>" * 3]
    ids = encoder(default_path())
    assert [ids(t) for t in texts] == library_ids(texts)


def test_token_counts_and_cache(spark, odd, tmp_path):
    cache = str(tmp_path / "cache")
    source = [(r.doc_id, r.text or "") for r in odd.collect()]
    expected = sorted(((i, len(t.encode()), len(ids)) for (i, t), ids in zip(source, library_ids([t for _, t in source]), strict=True)), key=str)
    for _ in range(2):  # the second time every count comes from the cache
        assert sorted(map(tuple, tokencount.count_tokens(odd, cache=cache).collect()), key=str) == expected
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content").distinct().count() == len({t for _, t in source})
    assert {r.tokenizer for r in stored.collect()} == {version_digest(default_path())}
    other = default_path("piece_bpe_32k.model")
    tokencount.count_tokens(odd.where("doc_id < 5"), other, cache).collect()
    assert {r.tokenizer for r in spark.read.parquet(cache).collect()} == {version_digest(default_path()), version_digest(other)}


def test_a_second_call_encodes_nothing(spark, odd, tmp_path):
    cache = str(tmp_path / "kept")
    spark.conf.set(tokencount.CACHE, cache)
    try:
        first = sorted(map(tuple, tokencount.count_tokens(odd).collect()), key=str)
        known = tokencount.read_cache(spark, cache, version_digest(default_path()))
        assert tokencount.encode_misses(odd.select("text"), known, default_path()).count() == 0
        stored = spark.read.parquet(cache).count()
        assert sorted(map(tuple, tokencount.count_tokens(odd, rounds=3).collect()), key=str) == first
        assert spark.read.parquet(cache).count() == stored
    finally:
        spark.conf.unset(tokencount.CACHE)


def test_the_faster_library_needs_the_same_merges_and_pattern(tmp_path):
    import json
    import shutil

    from sparkloom.llm import tokenization

    assert tokenization._same_ranks(default_path()) is not None
    shutil.copy(default_path("byte_bpe_50k.tiktoken"), tmp_path / "a.tiktoken")
    whole = json.loads(open(default_path()).read())
    whole["model"]["merges"][100:102] = reversed(whole["model"]["merges"][100:102])
    (tmp_path / "a.json").write_text(json.dumps(whole))
    assert tokenization._same_ranks(str(tmp_path / "a.json")) is None


# Packing


def test_packing_places_every_id_once(odd):
    source = defaultdict(list)
    for r in odd.collect():
        source[r.doc_id].append(r.text or "")
    found = packing.pack(odd, sequence=256).collect()
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for doc, texts in source.items():
        expected = []
        for ids in library_ids(texts):
            ids = np.array([*ids, 1], "<u4")
            expected += [(s, len(ids[s : s + 256]), zlib.crc32(ids[s : s + 256].tobytes()), len(ids)) for s in range(0, len(ids), 256)]
        assert sorted(by_doc[doc]) == sorted(expected)
    assert sorted(sequences) == list(range(len(sequences)))


def test_plan_uses_every_length_once_and_pads_little():
    r = random.Random(1)
    histogram = {n: r.randrange(1, 50) for n in r.sample(range(1, 2049), 900)}
    plan = packing.plan_packs(histogram, 2048)
    used = defaultdict(int)
    for pattern, n in plan:
        assert sum(pattern) <= 2048
        for length in pattern:
            used[length] += n
    assert used == histogram
    assert sum(sum(p) * n for p, n in plan) / (2048 * sum(n for _, n in plan)) > 0.98


# Decontamination


def test_decontamination(spark):
    r = random.Random(4)
    vocabulary = ["the", "of", "and", "a"] * 40 + [f"q{i}" for i in range(3000)]
    prose = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [(i, prose(r.randrange(16, 60))) for i in range(230)] + [(900, None), (None, "x y"), (901, ""), (3, None)]
    docs = [(i, prose(r.choice([1, 30, 300, 2000]))) for i in range(120)]
    want = set()
    for i in range(0, 60, 3):
        item, text = items[i][1], docs[i][1].split()
        at = r.randrange(len(text) + 1)
        words = item.split()
        if i % 2:
            words = [w for w in words if r.random() > 0.12]
        docs[i] = (i, " ".join([*text[:at], *words, *text[at:]]).upper())
        want.add((i, items[i][0]))
    docs += [(500, None), (501, ""), (None, items[0][1]), (0, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    found = decontam.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in found if x.doc_id is not None} == want
    assert {x.item_id for x in found if x.doc_id is None} == {0}
    assert sum(x.doc_id == 0 for x in found) == 2
    left = decontam.clean(df, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == df.columns and {x.doc_id for x in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_decontamination_finds_a_hot_item_and_every_text_of_an_item(spark):
    r = random.Random(8)
    items = [(i, " ".join(r.randbytes(3).hex() for _ in range(24))) for i in range(6)]
    items.append((5, " ".join(r.randbytes(3).hex() for _ in range(24))))
    rows, expected = [], set()
    for i in range(120):
        words = [r.randbytes(3).hex() for _ in range(r.randrange(60, 200))]
        held = {0} if i < 50 else {5} if i in (60, 61) else set()
        for item in held:
            text = items[6][1] if i == 61 else items[item][1]
            at = r.randrange(len(words))
            words[at:at] = text.split()
        expected |= {(i, x) for x in held}
        rows.append((i, " ".join(words)))
    found = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in found} == expected and len(found) == len(expected)


def test_decontamination_against_every_place_and_in_groups(spark, data, monkeypatch):
    docs, benchmark = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    frequency, texts, settings = defaultdict(int), {r.doc_id: decontam.words_of(r.text) for r in docs.collect()}, decontam.Settings()
    for words in texts.values():
        for w in set(words):
            frequency[w] += 1
    items = {r.item_id: decontam.words_of(r.text) for r in benchmark.collect()}
    stop, most = settings.common * len(texts), max(map(len, items.values()))
    answers = {i: frozenset(sorted({w for w in words if frequency[w] <= stop}, key=lambda w: (frequency[w], w))[: settings.answer_words]) for i, words in items.items()}
    expected = set()
    for d, words in texts.items():
        for start, _ in decontam.passages(len(words)):
            have = set(words[max(0, start - most) : start + 32 + most])
            for i, item in items.items():
                if (d, i) not in expected and len(answers[i] & have) >= settings.answer * len(answers[i]) and decontam.confirm(words, start, item, answers[i], settings)[0] >= settings.lcs:
                    expected.add((d, i))
    found = sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, benchmark).collect())
    assert len(expected) >= 3 and set(found) == expected and len(found) == len(expected)
    monkeypatch.setattr(decontam, "GROUP", 1000)
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, benchmark).collect()) == found
    monkeypatch.setattr(decontam, "MOST", 1000)
    with pytest.raises(ValueError):
        decontam.contaminated(docs, benchmark)


def test_paraphrases_are_found(spark, data):
    r = random.Random(12)
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    host = [x.text.split() for x in spark.read.parquet(f"{data}/documents.parquet").collect() if x.text]
    pool = [w for words in host for w in words[:200]]
    docs = []
    for i, (_, text) in enumerate(items):
        words, at = r.choice(host)[:600], r.randrange(100)
        docs.append((i, " ".join([*words[:at], *[r.choice(pool) if r.random() < 0.3 else w for w in text.split()], *words[at:]])))
    found = {(x.doc_id, x.item_id) for x in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sum((i, item) in found for i, (item, _) in enumerate(items)) >= 0.95 * len(items)


def test_words_that_no_document_has_are_no_answers(spark):
    item = [f"item{i}" for i in range(40)]
    # a changed word is rarer than all that were kept: no document has it
    changed = " ".join(f"other{i}" if i % 4 == 0 else w for i, w in enumerate(item))
    docs = spark.createDataFrame([(1, changed), *((i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(2, 9))], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.contaminated(docs, spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")).collect()] == [(1, 5)]


def test_decontamination_without_items(spark, odd):
    assert decontam.contaminated(odd, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_common_subsequence():
    r = random.Random(6)
    for _ in range(200):
        a, b = [[r.choice("abcd") for _ in range(r.randrange(0, 15))] for _ in range(2)]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontam.common_subsequence(a, b) == t[-1][-1]


def resident_mb(pid):
    return next(int(x.split()[1]) for x in open(f"/proc/{pid}/status") if x.startswith("VmRSS")) / 1024


def test_the_driver_returns_what_it_has_freed(spark):
    libc, size, n = ctypes.CDLL(None), 1 << 16, 1600
    libc.malloc.restype, libc.malloc.argtypes, libc.free.argtypes = ctypes.c_void_p, [ctypes.c_size_t], [ctypes.c_void_p]
    taken = [libc.malloc(size) for _ in range(n)]
    for x in taken:
        ctypes.memset(x, 1, size)
    for x in taken[:-1]:  # the last one holds what lies below it
        libc.free(x)
    jvm, held = spark._jvm, [spark._jvm.java.nio.ByteBuffer.allocateDirect(size) for _ in range(n)]
    last, pid = held.pop(), jvm.java.lang.ProcessHandle.current().pid()
    del held
    for _ in range(2):
        gc.collect()
        jvm.System.gc()
        time.sleep(0.5)
    before = {p: resident_mb(p) for p in ("self", pid)}
    free_shuffles(spark)
    after = {p: resident_mb(p) for p in before}
    libc.free(taken[-1])
    assert last.capacity() == size
    assert all(before[p] - after[p] > 50 for p in before), (before, after)

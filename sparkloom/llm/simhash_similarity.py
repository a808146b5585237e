"""SimHash near-duplicates by shingle similarity, for limits far beyond a few bits of one fingerprint.

The similarity is that which SimHash estimates, the cosine of shingle sets (`measure` can be jaccard). Candidates
come from two searches and are checked exactly, on whole texts. One is the grid range join of `simhash` over the
popcount embeddings of whole-document fingerprints. But fingerprints of texts with a similarity of 0.8 differ in ten
bits and more, which no grid can search. So, for the other, a document gets 48 keys of three least shingle hashes
each (MinHash), whatever its length. Texts with a cosine of 0.8 have at least 0.64 of their shingles in common (Jaccard),
and such texts share a key with probability 1 - (1 - 0.64^3)^48: they miss each other once in two million cases.

Texts that share a key are a bucket. They first meet its hubs; then those of a bucket that are still in different
components meet each other if they share one of their rarest shingles, as similar texts must (prefix filter), so that
a passage which many texts have in common makes no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_list, free_shuffles, id_text, is_empty, look_up, map_arrow, settle
from .components import connected_components
from .simhash import CHUNK, embedding, links

#: Keys of a text, and the least hashes in each.
BANDS, LEAST = 48, 3
FLIPS, FACTORS = np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS * LEAST, 1), np.uint64) | np.array([0, 1], np.uint64)[:, None, None]
#: Texts and shingles of a bucket's block, and shingles compared at a time.
BLOCK_TEXTS, BLOCK_SHINGLES, COLUMNS = 256, 1 << 18, 1 << 13
#: Pairs of one hub that one task checks, and texts of a group whose pairs are listed.
PAIRS, FEW = 256, 32
#: Tasks that blocks are dealt over at most.
DEALT = 10_000
MEASURES = ("cosine", "jaccard")


def shingle_hashes(text: bytes, k: int, seed: int = 42) -> np.ndarray:
    """Distinct XXH64 of the text's k-word shingles (A-Z lower-cased); a shorter text is one shingle, an empty one has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(k, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    stops = (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, stops, strict=False)), np.uint64, len(stops)))


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def majority(hashes: np.ndarray) -> int:
    """Fingerprint of a set of shingle hashes; 0 for none."""
    if not len(hashes):
        return 0
    ones = sum(_bits(hashes[s : s + CHUNK]).sum(axis=0, dtype=np.int64) for s in range(0, len(hashes), CHUNK))
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band: its number and the least of the set's hashes under each of its functions."""
    if not len(hashes):
        return []
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max)
    for s in range(0, len(hashes), CHUNK):
        np.minimum(least, ((hashes[s : s + CHUNK] ^ FLIPS) * FACTORS).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(x.tobytes(), i) - (1 << 63) for i, x in enumerate(least.reshape(BANDS, LEAST))]


def similar(common: np.ndarray | int, p: np.ndarray | int, q: np.ndarray | int, similarity: float, measure: str = "cosine") -> np.ndarray | bool:
    """Whether sets of p and q shingles with so many in common have the similarity."""
    least = similarity * (np.sqrt(p * q) if measure == "cosine" else p + q - common)
    return (common >= least - 1e-9) & (common > 0)


def block_links(sets: list[np.ndarray], labels: list[int], similarity: float, measure: str = "cosine") -> list[tuple[int, int]]:
    """Places of similar sets of different labels, as many as link those labels."""
    sizes = np.array([len(x) for x in sets])
    found, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[at]
    row = np.repeat(np.arange(len(sets)), sizes)[column >= 0]
    column = column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)))
    for start in range(0, int((n > 1).sum()), COLUMNS):
        lo, hi = np.searchsorted(column, (start, start + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[lo:hi], column[lo:hi] - start] = 1
        common += part @ part.T
    near = similar(common, sizes[:, None].astype(np.float64), sizes, similarity, measure)
    roots = {x: x for x in labels}

    def root(x: int) -> int:
        while roots[x] != x:
            roots[x] = x = roots[roots[x]]
        return x

    out = []
    for i, j in np.argwhere(np.triu(near, 1)).tolist():
        x, y = root(labels[i]), root(labels[j])
        if x != y:
            roots[x] = y
            out.append((i, j))
    return out


class Texts:
    """Whole texts of nodes. Rows that share a node's doc_id but not its digest are dropped where a text is read."""

    def __init__(self, rows: DataFrame, nodes: DataFrame) -> None:
        self.rows, self.nodes = rows, nodes

    def of(self, wanted: DataFrame) -> DataFrame:
        """(node, digest, text) of the nodes in `wanted`."""
        named = settle(self.nodes.join(wanted.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "digest"))
        return named.join(self.rows, "doc_id").select("node", "digest", F.coalesce("text", F.lit("")).alias("text"))


def _digest(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(text.lower().split()))


def _rare(members: DataFrame, texts: Texts, similarity: float, words_in_shingle: int, measure: str) -> DataFrame:
    """(key, node, label, size): members (node, label) dealt by each of their rarest shingles that others have among theirs.

    A set shares similarity^2 (cosine) or similarity (jaccard) of its shingles with a similar one at least. So if each
    leaves out fewer of its shingles than that, in an order common to all, a pair that is similar still shares one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = batch.column(2).to_pylist()
            for i, text in enumerate(binary_list(batch, "text")):
                if _digest(text) == digests[i]:
                    h = shingle_hashes(text, words_in_shingle).view(np.int64)
                    same = [pa.array(np.full(len(h), x), pa.int64()) for x in (batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), len(h))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(h)], ["node", "label", "size", "key"])

    held = members.join(texts.of(members), "node").select("node", "label", "digest", "text")
    tokens = settle(map_arrow(held, run, "node long, label long, size long, key long").distinct())
    often = settle(tokens.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    free_shuffles(members.sparkSession)
    first = look_up(tokens, often, "key").groupBy("node", "label", "size").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("all"))
    share = F.lit(similarity**2 if measure == "cosine" else similarity)
    kept = F.slice("all", 1, (F.col("size") - F.ceil(F.col("size") * share - 1e-9) + 1).cast("int"))
    rare = first.select("node", "label", "size", F.explode(F.filter(kept, lambda x: x["n"] > 1)).alias("x"))
    return rare.select("x.key", "node", "label", "size")


def _open(members: DataFrame) -> DataFrame:
    """Members of groups with more than one label, and in `n` how many a group has."""
    labels = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high")
    return members.join(labels.select("key", "n"), "key")


def _rest(shared: DataFrame, hubs: DataFrame, edges: DataFrame, checked: DataFrame, texts: Texts, similarity: float, words_in_shingle: int, measure: str) -> DataFrame | None:
    """(src, dst) between texts of a bucket that edges leave in different components, hubs apart; None if there are no such texts.

    They meet by their rarest shingles: pair by pair in small groups, in blocks of bounded size in large ones.
    """
    roots = connected_components(edges)
    apart = shared.select("key", "node").join(hubs, "key").where("not array_contains(hubs, node)").select("key", "node")
    apart = apart.join(roots, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
    members = settle(_open(apart).select("node", "label").distinct())
    if is_empty(members):
        return None
    free_shuffles(members.sparkSession)
    met = settle(_open(_rare(members, texts, similarity, words_in_shingle, measure)))
    free_shuffles(members.sparkSession)
    few = met.where(F.col("n") <= FEW).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "label"))).alias("all")).select("all").distinct()
    others = lambda x: F.transform(F.filter("all", lambda y: (y["node"] > x["node"]) & (y["label"] != x["label"])), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))
    pairs = few.select(F.explode(F.flatten(F.transform("all", others))).alias("p")).select("p.a", "p.b").distinct()
    found = _checked(settle(pairs.join(checked, ["a", "b"], "left_anti")), texts, similarity, words_in_shingle, measure)
    many = settle(met.where(F.col("n") > FEW))
    return found if is_empty(many) else found.union(_in_blocks(_merged(many), texts, similarity, words_in_shingle, measure))


def _merged(many: DataFrame) -> DataFrame:
    """Members of large groups. Groups that hang together are one where it has no more pairs than they have: then a pair meets once."""
    groups = many.groupBy("key").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n"))
    roots = settle(connected_components(many.join(groups.select("key", F.col("node").alias("src")), "key").select("src", F.col("node").alias("dst"))))
    groups = settle(groups.join(roots, "node").select("key", "component", "n"))
    single = settle(many.select("node", "label", "size").distinct().join(roots, "node"))
    apart = groups.groupBy("component").agg(F.sum(F.col("n") * F.col("n")).alias("apart"))
    whole = single.groupBy("component").agg(F.count(F.lit(1)).alias("n")).join(apart, "component").where(F.col("n") * F.col("n") <= F.col("apart")).select("component")
    whole = settle(whole)
    merged = single.join(whole, "component").select(F.xxhash64("component", F.lit("merged")).alias("key"), "node", "label", "size")
    left = many.join(groups.join(whole, "component", "left_anti").select("key"), "key", "left_semi")
    return settle(merged.union(left.select("key", "node", "label", "size")))


def _in_blocks(members: DataFrame, texts: Texts, similarity: float, words_in_shingle: int, measure: str) -> DataFrame:
    """(src, dst) in groups of any size: the texts outside a group's largest component meet each other and those inside it."""
    labels = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    top = labels.groupBy("key").agg(F.max(F.struct("n", "label", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK_TEXTS, size / BLOCK_SHINGLES)).cast("int")
    top = settle(top.select("key", F.col("top.label").alias("main"), blocks(F.col("top.n"), F.col("top.size")).alias("inside"), blocks(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("outside")))
    dealt = members.join(top, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("label") == F.col("main"), F.col("inside")).otherwise(F.col("outside"))).cast("int"))
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    meeting = lambda main, i, j: F.struct(F.lit(main).alias("main"), i.alias("i"), j.alias("j"))
    among = F.transform(numbers("outside"), lambda x: meeting(False, F.least("block", x), F.greatest("block", x)))
    across = F.transform(numbers("inside"), lambda x: meeting(True, F.col("block"), x))
    visits = F.when(F.col("label") == F.col("main"), F.transform(numbers("outside"), lambda x: meeting(True, x, F.col("block")))).otherwise(F.concat(among, across))
    # blocks that hold the same texts meet once
    dealt = dealt.select("key", "node", "label", F.explode(visits).alias("visit"))
    met = dealt.groupBy("key", "visit").agg(F.sort_array(F.collect_set(F.struct("node", "label"))).alias("all")).select("all").distinct()
    met = settle(met.where(F.size("all") > 1).select(F.monotonically_increasing_id().alias("block"), "all"))
    single = met.select("block", F.explode("all").alias("x")).select("block", "x.node", "x.label")
    # few rows, but each is a block's work
    met = single.join(texts.of(single), "node").repartition(min(DEALT, max(1, met.count())), "block").groupBy("block").agg(*[F.collect_list(c).alias(f"{c}s") for c in ("node", "label", "digest", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                found = {n: (label, text) for n, label, digest, text in zip(*(batch.column(c)[i].as_py() for c in range(4)), strict=True) if _digest(text.encode()) == digest}
                at = list(found)
                sets = [shingle_hashes(t.encode(), words_in_shingle) for _, t in found.values()]
                out += [(at[x], at[y]) for x, y in block_links(sets, [x for x, _ in found.values()], similarity, measure)]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(2)], ["src", "dst"])

    return map_arrow(met.select("nodes", "labels", "digests", "texts"), run, "src long, dst long")


def _checked(pairs: DataFrame, texts: Texts, similarity: float, words_in_shingle: int, measure: str) -> DataFrame:
    """(src, dst): the pairs (a, b) whose whole texts are similar.

    The end with more pairs, which may be a hub of a very large bucket, is dealt over as many places as its pairs need,
    and its text goes to each of them.
    """
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    ends = settle(ends)
    counted = pairs.join(ends.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a").join(ends.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b")
    less = F.col("n_a") < F.col("n_b")
    sides = counted.select(F.when(less, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(less, F.col("b")).otherwise(F.col("a")).alias("dst"), F.greatest("n_a", "n_b").alias("n"))
    places = lambda n: F.ceil(n / PAIRS).cast("int")
    sides = settle(sides.withColumn("place", F.pmod(F.xxhash64("src"), places(F.col("n"))).cast("int")))
    known = texts.of(ends)
    near = known.select(F.col("node").alias("src"), F.col("digest").alias("digest_a"), F.col("text").alias("text_a"))
    hubs = sides.groupBy("dst").agg(F.max("n").alias("n"))
    far = known.join(hubs.withColumnRenamed("dst", "node"), "node").select(F.col("node").alias("dst"), F.explode(F.sequence(F.lit(0), places(F.col("n")) - 1)).alias("place"), F.col("digest").alias("digest_b"), F.col("text").alias("text_b"))
    both = sides.join(near, "src").join(far, ["dst", "place"]).select("src", "dst", "digest_a", "digest_b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, p = b"", np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            sides = (batch.column(2).to_pylist(), batch.column(3).to_pylist(), binary_list(batch, "text_a"), binary_list(batch, "text_b"))
            for digest_a, digest_b, x, y in zip(*sides, strict=True):
                if y != last:  # the pairs of a hub follow each other
                    last, p = y, shingle_hashes(y, words_in_shingle)
                if _digest(x) != digest_a or _digest(y) != digest_b:
                    keep.append(False)
                    continue
                q = shingle_hashes(x, words_in_shingle)
                keep.append(bool(similar(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q), similarity, measure)))
            yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(both, check, "src long, dst long").distinct()


def _fewer(edges: DataFrame) -> DataFrame:
    """Links with the same components: of a text's links to hubs one stays, and its hubs are linked to each other instead."""
    first = edges.groupBy("src").agg(F.min("dst").alias("first"))
    hubs = edges.join(first, "src").where("dst <> first").select(F.col("dst").alias("src"), F.col("first").alias("dst"))
    return first.select("src", F.col("first").alias("dst")).union(hubs).distinct()


def near_duplicates(docs: DataFrame, similarity: float = 0.8, words_in_shingle: int = 5, measure: str = "cosine") -> DataFrame:
    """(doc_id, component_id): groups of documents linked by a similarity of their shingle sets of at least `similarity`.

    Texts that are equal after lower-casing A-Z and joining words by one space are one node. Nodes that share a key meet two
    hubs, the first and the one with the most company over all its keys, and then whoever is still in another component;
    each meeting is checked on the whole texts.
    Nulls: a null text counts as empty; texts without words are one group. A null doc_id gets a null
    component and takes no part. Repeated rows come back repeated, and rows that share a doc_id but not the text
    are judged each by its text; an empty table gives an empty result.
    """
    if measure not in MEASURES or not 0 < similarity <= 1:
        raise ValueError(f"a similarity is above 0 and at most 1, by {' or '.join(MEASURES)}")
    rows = id_text(docs).where("doc_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = binary_list(batch, "text")
            hashes = [shingle_hashes(t, words_in_shingle) for t in listed]
            prints = np.array([majority(h) for h in hashes], np.uint64)
            columns = [pa.array(map(_digest, listed), pa.binary()), pa.array(prints.view(np.int64)), pa.array(embedding(prints).view(np.int64)), pa.array(map(band_keys, hashes), pa.list_(pa.int64())), pa.array(map(len, hashes), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "digest", "fp", "cell", "keys", "size"])

    made = settle(map_arrow(rows, run, "doc_id long, digest binary, fp long, cell long, keys array<long>, size long"))
    # nodes are numbered, for two texts may have one smallest doc_id; components are named by doc_id at the end
    owners = settle(made.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).withColumn("node", F.monotonically_increasing_id()))
    held = made.join(owners.select("digest", "doc_id", "node"), ["digest", "doc_id"]).dropDuplicates(["node"])
    nodes = settle(held.select("node", "doc_id", "digest", "fp", "cell", "size", "keys"))
    texts = Texts(rows, nodes)
    free_shuffles(docs.sparkSession)
    prints = settle(nodes.groupBy("fp", "cell").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n")))
    alike = look_up(nodes.select("fp", "node"), prints.select("fp", "n", F.col("node").alias("b")), "fp").select(F.col("node").alias("a"), "b").where("a <> b")
    alike = alike.union(links(prints).select(F.col("src").alias("a"), F.col("dst").alias("b")))
    spread = nodes.select("node", F.explode("keys").alias("key"))
    met = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"))
    met = settle(met.where("n > 1"))
    shared = settle(spread.join(met.select("key", "n"), "key"))
    company = shared.groupBy("node").agg(F.sum("n").alias("company"))
    most = shared.join(company, "node").groupBy("key").agg(F.max(F.struct("company", "node")).getField("node").alias("most"))
    hubs = settle(met.join(most, "key").select("key", F.array_distinct(F.array("low", "most")).alias("hubs")))
    pairs = shared.join(hubs, "key").select(F.col("node").alias("a"), F.explode("hubs").alias("b")).where("a <> b").union(alike)
    pairs = settle(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    free_shuffles(docs.sparkSession)
    edges = settle(_fewer(settle(_checked(pairs, texts, similarity, words_in_shingle, measure))))
    rest = _rest(shared, hubs, edges, pairs, texts, similarity, words_in_shingle, measure)
    edges = edges if rest is None else settle(edges.union(rest))
    free_shuffles(docs.sparkSession)
    roots = connected_components(edges)
    named = settle(owners.join(roots, "node", "left").select("digest", "doc_id", "n", F.coalesce("component", "node").alias("group")))
    least = settle(named.groupBy("group").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("texts")))
    named = settle(look_up(named.select("digest", "n", "group"), least, "group", "texts").select("digest", "n", "component_id"))
    known = look_up(made.select("doc_id", "digest"), named, "digest").select("doc_id", "component_id")
    return known.union(id_text(docs).where("doc_id is null").select("doc_id", F.lit(None).cast("long")))

"""MinHash near-dedup: documents whose word shingles have a weighted Jaccard similarity of 0.8 or more.

Method: DartMinHash. A shingle that occurs c times has a region of weight c. Darts fall on each unit of weight at ranks
that a hash draws, and each dart hits one of the coordinates. The earliest dart of a coordinate is its signature value;
two documents agree in it with the probability of their weighted Jaccard similarity. Darts are thrown only as far as a
document of its size needs, so sparse documents cost no more than their darts. Signatures are cut into bands; documents
that share a band are candidates, and each candidate pair is checked exactly on the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

U64 = C.U64
#: Units below which a document's darts are thrown in one go.
SMALL = 40
#: Pivots of the largest bucket in the first round that looks at all pairs, and 64-bit numbers of a node's bit set.
PIVOTS, LONGS = 32, 32


def shingle_units(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """One number for each occurrence of a shingle (the nth occurrence in a text differs from the first), in order of
    text, and the first unit of each text. A text of fewer words has one shingle, of all its words."""
    s, e, first = C.words(data, off, C.NOT_SPACE)
    h = C.word_hashes(data, s, e)
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    text = np.repeat(np.arange(len(n)), count)
    at = C.spread(first[:-1], count)
    pre = C.prefix_hash(h)
    g = C.span_hash(pre, at, np.minimum(at + size, first[text + 1]))
    order = np.lexsort((g, text))
    g, new = g[order], np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    nth = np.arange(len(g)) - np.repeat(begin, np.diff(np.append(begin, len(g))))
    return C.mix(g + nth.astype(U64) * U64(0xA24BAED4963EE407)), np.concatenate([[0], np.cumsum(count)])


def _dart(unit: np.ndarray, j) -> np.ndarray:
    return C.mix(unit + np.asarray(j, U64) * U64(0x9FB21C651E98DF25))


def _gap(h: np.ndarray) -> np.ndarray:
    return -np.log(((h >> U64(11)).astype(np.float64) + 1.0) * 2.0**-53)


def signatures(units: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """For each text its k signature values: rank and identity of the earliest dart of each coordinate."""
    n = np.diff(first)
    out = np.full((len(n), k), np.iinfo(np.uint64).max, U64)
    flat = out.reshape(-1)
    far = np.zeros(len(n))
    far[n > 0] = k * (np.log(k) + 6) / n[n > 0]

    def throw(h, rank, text):
        at = text * k + (h % U64(k)).astype(np.int64)
        np.minimum.at(flat, at, (rank.astype(np.float32).view(np.uint32).astype(U64) << U64(32)) | (h >> U64(32)))

    open_ = np.flatnonzero(n > 0)
    while len(open_):
        big = open_[n[open_] >= SMALL]
        text = np.repeat(big, n[big])
        unit = units[C.spread(first[big], n[big])]
        rank, j = np.zeros(len(unit)), 0
        while len(unit):
            h = _dart(unit, j)
            rank = rank + _gap(_dart(h, 1))
            live = rank < far[text]
            unit, text, rank, h, j = unit[live], text[live], rank[live], h[live], j + 1
            throw(h, rank, text)
        little = open_[n[open_] < SMALL]
        reach = np.ceil(far[little] + 8 * np.sqrt(far[little]) + 16)
        for bits in np.unique(np.ceil(np.log2(reach))) if len(little) else []:
            own = little[np.ceil(np.log2(reach)) == bits]
            text = np.repeat(own, n[own])
            unit = units[C.spread(first[own], n[own])]
            step = max(1, (1 << 19) >> int(bits))
            for a in range(0, len(unit), step):
                h = _dart(unit[a : a + step, None], np.arange(1 << int(bits))[None, :])
                rank = np.cumsum(_gap(_dart(h, 1)), axis=1)
                live = rank < far[text[a : a + step], None]
                throw(h[live], rank[live], np.broadcast_to(text[a : a + step, None], h.shape)[live])
        open_ = open_[(out[open_] == np.iinfo(np.uint64).max).any(axis=1)]
        far[open_] *= 2  # a coordinate without a dart: go further
    return out


def band_keys(values: np.ndarray, bands: int) -> np.ndarray:
    v = values.reshape(len(values), bands, -1)
    out = np.zeros(v.shape[:2], U64)
    for j in range(v.shape[2]):
        out = C.mix(out * U64(0x9E3779B97F4A7C15) + v[:, :, j])
    return out


def signed(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, keys (empty where the text has no words)."""

    def work(batch):
        for part in C.slices(batch, "text", C.SLICE_BYTES // 2):
            data, off = C.text_bytes(part.column("text"))
            units, first = shingle_units(data, off, shingle)
            keys = band_keys(signatures(units, first, bands * rows), bands)
            size = np.where(np.diff(first) > 0, bands, 0)
            flat = keys[size > 0].reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), lists], ["doc_id", "text_key", "keys"])

    rows_ = docs.select("doc_id", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key"))
    return C.per_batch(rows_, work, "doc_id long, text_key binary, keys array<long>")


def shingled(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node, n, units, bits, slack: the shingles of the nodes' texts as numbers, each once (the nth occurrence differs from
    the first); a bit for each by a hash, and how many shingles have no bit of their own."""
    texts = docs.join(nodes.hint("merge"), docs["doc_id"] == nodes["node"]).groupBy("node").agg(F.min("text").alias("text"))

    def work(batch):
        for part in C.slices(batch, "text", C.SLICE_BYTES // 2):
            units, first = shingle_units(*C.text_bytes(part.column("text")), shingle)
            n = np.diff(first)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(units.view(np.int64)))
            held = np.zeros(len(n) * LONGS, U64)
            place = np.repeat(np.arange(len(n)) * LONGS, n) + ((units >> U64(6)) % U64(LONGS)).astype(np.int64)
            np.bitwise_or.at(held, place, U64(1) << (units & U64(63)))
            slack = n - np.bitwise_count(held).reshape(len(n), LONGS).sum(axis=1, dtype=np.int64)
            bits = pa.FixedSizeListArray.from_arrays(pa.array(held.view(np.int64)), LONGS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(n), lists, bits, pa.array(slack)], ["node", "n", "units", "bits", "slack"])

    return C.per_batch(texts, work, "node long, n long, units array<long>, bits array<long>, slack long")


def hopeful(buckets: DataFrame, units: DataFrame, least: float) -> DataFrame:
    """buckets (band, key, node) with n and known, how many of the node's n shingles any other of these nodes has: only
    those nodes that can be similar enough to another. Shingles are counted before they are shuffled."""
    alone = units.select("node", F.explode("units").alias("unit")).groupBy("unit").agg(F.count("*").alias("c"), F.min("node").alias("node")).filter("c = 1")
    alone = alone.groupBy("node").agg(F.count("*").alias("alone"))
    able = units.select("node", "n").join(alone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("known"))
    able = C.written(able.filter(F.col("known") >= least * F.col("n") - 1e-9), "hopeful")
    return C.written(buckets.join(able, "node"), "buckets")


def can_meet(n_a, known_a, n_b, known_b, least: float):
    """Whether two nodes may be similar enough, from the counts of hopeful: they share at most the lesser known count."""
    most = F.least(known_a, known_b) if known_a is not known_b else known_a
    return most * (1 + least) >= least * (n_a + n_b) - 1e-9


def checked(pairs: DataFrame, units: DataFrame, least: float) -> DataFrame:
    """Those pairs (a, b) that are similar enough by their shingles, with their similarity."""
    side = lambda s: units.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("units").alias(f"units_{s}"))
    common = F.size(F.array_intersect("units_a", "units_b"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", (common / (F.col("n_a") + F.col("n_b") - common)).alias("similarity"))
    return both.filter(F.col("similarity") >= least)


def labelled(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """buckets with the label of each node's class."""
    if labels is None:
        return buckets.withColumn("label", F.col("node"))
    return buckets.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")


def joined(good: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Classes of all nodes with a link, after the links good; what is known is one link from each node to its class."""
    links = good.select("a", "b")
    if labels is not None:
        links = links.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return components(links)


def with_first(now: DataFrame, order, least: float) -> DataFrame:
    """Pairs (a, b) of each node with the first node by order of each of its buckets that hold several classes."""
    first = F.min(F.struct(order.alias("o"), "node", "label", "n", "known")).alias("first")
    heads = C.written(now.groupBy("band", "key").agg(F.min("label").alias("x"), F.max("label").alias("y"), first).filter("x < y").select("band", "key", "first"), "heads")
    met = now.join(heads, ["band", "key"]).filter("first.label <> label").filter(can_meet(F.col("n"), F.col("known"), F.col("first.n"), F.col("first.known"), least))
    return met.select(F.least("node", "first.node").alias("a"), F.greatest("node", "first.node").alias("b")).distinct()


def mixed(now: DataFrame, units: DataFrame) -> DataFrame:
    """The rows of buckets that hold several classes, with the label of the bucket's largest class, the node's bits and slack."""
    sizes = now.groupBy("band", "key", "label").agg(F.count("*").alias("c"))
    heads = sizes.groupBy("band", "key").agg(F.count("*").alias("kinds"), F.sum("c").alias("size"), F.max_by("label", F.struct("c", "label")).alias("largest")).filter("kinds > 1")
    return C.written(now.join(C.written(heads.drop("kinds"), "heads"), ["band", "key"]).join(units.select("node", "slack", "bits"), "node"), "mixed")


def across(now: DataFrame, level: int, top: int, least: float) -> DataFrame:
    """Pairs (a, b) of nodes that share a bucket, but no class, can be similar enough, and of which the higher node is at
    this level (0 to top, a quarter as many nodes at each). One of a pair isn't of the bucket's largest class, so that class
    never meets itself. Two nodes share at most as many shingles as bits, and the lesser slack more."""
    u = (F.pmod(F.xxhash64("node", F.lit("level")), F.lit(1 << 40)) + 1) / float(1 << 40)
    now = now.withColumn("level", F.least(F.lit(top), F.floor(-F.log(u) / np.log(4.0)).cast("int"))).filter(F.col("level") <= level)
    minor = now.filter("label <> largest")
    cols = ("node", "label", "n", "known", "slack", "bits")
    side = lambda df, s: df.select("band", "key", *(F.col(c).alias(f"{c}_{s}") for c in cols))
    both = F.zip_with("bits_p", "bits_q", lambda x, y: F.bit_count(x.bitwiseAND(y)))
    shared = F.aggregate(both, F.lit(0).cast("long"), lambda a, x: a + x) + F.least("slack_p", "slack_q")
    meet = lambda p, q: can_meet(F.col("n_p"), p, F.col("n_q"), q, least)
    able = (F.col("label_p") != F.col("label_q")) & meet(F.col("known_p"), F.col("known_q")) & meet(shared, shared)
    here = F.col("level") == level
    met = [side(x, "p").join(side(y, "q"), ["band", "key"]).filter(able) for x, y in ((minor.filter(here), now), (minor.filter(~here), now.filter(here)))]
    return met[0].unionByName(met[1]).select(F.least("node_p", "node_q").alias("a"), F.greatest("node_p", "node_q").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, least: float = 0.8, bands: int = 48, rows: int = 8, rounds: int = 2) -> DataFrame:
    """doc_id, class_id for each row of docs; class_id is the least doc_id of the class.

    Equal texts are one node. Nodes that share a bucket (band and key) with another are candidates. One of which too many
    shingles stand in no other candidate can't be similar enough to any and is settled by that. The others are first held
    against one node of each of their buckets: in the first round the one with the largest share of shingles that others
    have too, then one that a hash draws. These rounds only make classes quickly: after them every pair that shares a
    bucket, but no class, is checked, from few pivots to all nodes, without a cap.
    Null texts, texts without words and rows without doc_id are classes of their own. Rows that are repeated whole fall
    in one class; of different texts under one doc_id the least stands for the node.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = docs.filter("doc_id is not null and text is not null")
    sig = C.written(signed(named, shingle, bands, rows), "signatures")
    nodes = sig.filter(F.size("keys") > 0).groupBy("text_key").agg(F.min_by("keys", "doc_id").alias("keys"), F.min("doc_id").alias("node"))
    nodes = C.written(nodes, "nodes")
    buckets = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    shared = buckets.groupBy("band", "key").agg(F.count("*").alias("c")).filter("c > 1").drop("c")
    buckets = C.written(buckets.join(shared, ["band", "key"], "left_semi"), "shared")
    units = C.written(shingled(named, buckets.select("node").distinct(), shingle), "units")
    buckets = hopeful(buckets, units, least)
    labels, tried = None, None

    def settle(pairs):
        """Whether there were pairs; the links among them go to labels."""
        nonlocal labels, tried
        pairs = C.written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            return False
        tried = pairs if tried is None else tried.unionByName(pairs)
        good = C.written(checked(pairs, units, least), "similar")
        if not good.isEmpty():
            labels = joined(good, labels)
        return True

    for turn in range(rounds):
        order = F.xxhash64("node", F.lit(turn)) if turn else 1 - F.col("known") / F.col("n")
        if not settle(with_first(labelled(buckets, labels), order, least)):
            break
    rest = mixed(labelled(buckets, labels), units)
    most = rest.agg(F.max("size")).first()[0] or 0
    top = int(np.log(max(1.0, most / PIVOTS)) / np.log(4.0))
    for level in range(top, -1, -1):
        if rest.isEmpty():
            break
        if settle(across(rest, level, top, least)) and level:
            rest = mixed(labelled(buckets, labels), units)
    keyed = nodes.select("text_key", "node")
    if labels is not None:
        keyed = keyed.join(labels, "node", "left").select("text_key", F.coalesce("component", "node").alias("class"))
    else:
        keyed = keyed.withColumnRenamed("node", "class")
    classed = sig.select("doc_id", "text_key").distinct().join(keyed, "text_key").groupBy("doc_id").agg(F.min("class").alias("class"))
    classed = classed.withColumnRenamed("doc_id", "classed_id")
    return docs.select("doc_id").join(classed, F.col("doc_id") == F.col("classed_id"), "left").select("doc_id", F.coalesce("class", "doc_id").alias("class_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The document with the least doc_id of each class, with all its columns; of rows that are repeated (same doc_id and
    text) one stays. Rows without doc_id stay."""
    classes = near_duplicates(docs, **options)
    marks = classes.groupBy("doc_id").agg((F.min("class_id") < F.col("doc_id")).alias("__gone"), (F.count("*") > 1).alias("__again"))
    marks = C.written(marks.filter("doc_id is not null and (__gone or __again)").withColumnRenamed("doc_id", "__marked"), "marks")
    left = docs.join(marks, F.col("doc_id").cast("long") == F.col("__marked"), "left").filter("coalesce(__gone, false) = false").drop("__gone", "__marked")
    once = left.filter("coalesce(__again, false) = false").drop("__again")
    return once.unionByName(left.filter("__again").drop("__again").dropDuplicates(["doc_id", "text"]))


def op5_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"))

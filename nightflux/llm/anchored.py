"""Long repeats without comparing every text with every shard.

A text is a row of units (words or bytes). Each window of W units is keyed by the least hash of the k-grams in it: equal
windows have equal keys. Neighbouring windows with one key form a piece. Pieces whose key occurs once, and whose windows
differ from each other, can't hold a repeat; the others are dealt by key to small shards, where an index finds the
repeated windows. Equal pieces are one row with counts.

A key with very many different pieces, next to a task's share or to a block, is split by context (around the edge of a very
common passage): its windows are
told apart by how far the key's gram stands from their begin, in a few ranges of distances, and by the units that all
windows of such a range share. Equal windows have one distance and one context, so they still meet. What is still too
large is split again into finer ranges, at last into single distances, where the context is the whole window. Each split
makes a few parts of a piece; equal parts are one row again, so no shard grows with a common passage.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Keys with more different pieces than this may be split, into so many ranges of distances at a time.
CROWD, WAYS = 100, 8
#: They are where their pieces are over this part of a task's mean share, or fill over this part of a block.
OF_TASK, OF_BLOCK = 50, 4
#: Units of a block that is indexed at a time.
BLOCK = 1 << 19


@dataclass(frozen=True)
class Kind:
    """What a unit is. window and gram in units; longest: windows of a piece at most."""

    name: str
    window: int
    gram: int
    longest: int

    def units(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units of all texts as numbers, the first unit of each text, and the order of the grams that begin at each."""
        k = self.gram
        if self.name == "bytes":
            pre = C.prefix_hash(data)
            n = max(0, len(data) - k + 1)
            return data, off, C.mix((pre[k:] - pre[:n]) * C.powers(n)[1]) if n else np.zeros(0, C.U64)
        s, e, first = C.words(data, off, C.NOT_SPACE)
        h = C.word_hashes(data, s, e)
        g = C.grams(h, k) >> C.U64(1)
        letters = np.concatenate([[0], np.cumsum(e - s)])
        long = letters[k:] - letters[: len(letters) - k] >= 5 * k + 1  # grams of short, frequent words come last
        return h, first, np.where(long[: len(g)], g, g | C.U64(1 << 63))

    def hashes(self, units: np.ndarray):
        """A function that gives the hash of units[a:z] for each of many spans, of a gram or more."""
        if self.name != "bytes":
            pre = C.prefix_hash(units)
            return lambda a, z: C.span_hash(pre, a, z)
        u = np.concatenate([units, np.zeros(7, np.uint8)]).astype(C.U64)  # eight bytes at a time, mixed: no two texts of one pattern cancel out
        for step in (1, 2, 4):
            u = u[:-step] | u[step:] << C.U64(8 * step)
        pre = C.prefix_hash(C.mix(u))
        return lambda a, z: C.span_hash(pre, a, z - 7)

    def places(self, units: np.ndarray, first: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Where in the pieces that begin at first the gram of each piece's key stands."""
        k = self.gram
        n = max(0, len(units) - k + 1)
        if self.name == "bytes":
            pre = C.prefix_hash(units)
            g = C.mix((pre[k:] - pre[:n]) * C.powers(n)[1])
        else:
            g, key = C.grams(units, k) >> C.U64(1), key & C.U64((1 << 63) - 1)
        piece = np.searchsorted(first, np.arange(n), side="right") - 1
        return np.flatnonzero((g == key[piece]) & (np.arange(n) + k <= first[piece + 1]))

    def pieces(self, units: np.ndarray, first: np.ndarray, order: np.ndarray):
        """Key, hash, text, start (in its text) and number of windows of each piece."""
        w = self.window
        n = len(units) - w + 1
        if n <= 0:
            z = np.zeros(0, np.int64)
            return z.astype(C.U64), z.astype(C.U64), z, z, z
        key = C.sliding_min(order, w - self.gram + 1)
        length = np.diff(first)
        has = np.flatnonzero(length >= w)
        edge = np.zeros(n + 1, np.int64)
        edge[first[has]] += 1
        edge[first[has] + length[has] - w + 1] -= 1
        valid = np.cumsum(edge[:-1]) > 0
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (key[1:] != key[:-1])
        at = np.flatnonzero(new)
        count = np.diff(np.append(np.concatenate([[0], np.cumsum(valid)])[at], valid.sum()))
        parts = -(-count // self.longest)
        nth = C.spread(np.zeros(len(at), np.int64), parts)
        at, count = np.repeat(at, parts) + nth * self.longest, np.minimum(np.repeat(count, parts) - nth * self.longest, self.longest)
        text = np.searchsorted(first, at, side="right") - 1
        return key[at], self.hashes(units)(at, at + count - 1 + w), text, at - first[text], count

    def twice(self, order: np.ndarray, key: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Whether the gram of the key stands in the piece more than once: else its windows differ from each other."""
        m = self.window - self.gram + 1
        if not len(at):
            return np.zeros(0, bool)
        pad = np.full(m - 1, np.iinfo(np.uint64).max, C.U64)
        least = ~C.sliding_min(np.concatenate([pad, ~C.sliding_min(order, m), pad]), m)
        place = np.flatnonzero(order == least)  # grams that are the least of any window
        lo, hi = np.searchsorted(place, at), np.searchsorted(place, at + count - 1 + m)
        same = order[place[C.spread(lo, hi - lo)]] == np.repeat(key, hi - lo)
        return np.bincount(np.repeat(np.arange(len(at)), hi - lo), same, len(at)) > 1


OCCURRENCE = "anchor long, piece long, doc_id long, start int, n int"


def occurrences(docs: DataFrame, kind: Kind, within: bool) -> DataFrame:
    """The pieces of all texts; if within, also whether a window may start twice in the piece."""

    def work(batch):
        for part in C.slices(batch, "text"):
            data, off = C.text_bytes(part.column("text"))
            units, first, order = kind.units(data, off)
            key, piece, text, start, n = kind.pieces(units, first, order)
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)[text]
            more = [pa.array(kind.twice(order, key, first[text] + start, n))] if within else []
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(piece.view(np.int64)), pa.array(ids), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), *more], ["anchor", "piece", "doc_id", "start", "n", "twice"][: 5 + within])

    return C.per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null"), work, OCCURRENCE + ", twice boolean" * within)


def repeated(docs: DataFrame, kind: Kind, within: bool) -> DataFrame:
    """Pieces whose key occurs again: in another document, or anywhere if within."""
    found = C.written(occurrences(docs, kind, within), "occurrences")
    if within:
        keys = found.groupBy("anchor").agg(F.count("*").alias("c"), F.max("twice").alias("twice")).filter("c > 1 or twice")
    else:
        keys = found.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).filter("a < z")
    keys = C.written(keys.select("anchor"), "keys")
    return C.written(found.join(keys, "anchor"), "repeated")


def distinct_pieces(found: DataFrame) -> DataFrame:
    """One row for each different piece: in how many places, the least doc_id, a place to read it, how many different
    pieces its key has, and whether a window may start twice in it (where found says so)."""
    more = ["twice"] if "twice" in found.columns else []
    pieces = found.groupBy("anchor", "piece").agg(F.count("*").alias("places"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "start", "n")).alias("at"), *(F.max(c).alias(c) for c in more))
    kinds = pieces.groupBy("anchor").agg(F.count("*").alias("kinds"))
    return C.written(pieces.join(kinds, "anchor").select("anchor", "piece", "places", "least", "kinds", "at.doc_id", "at.start", "at.n", *more), "pieces")


FETCHED = "anchor long, piece long, places long, least long, kinds long, n int, units binary"


def fetched(docs: DataFrame, pieces: DataFrame, kind: Kind) -> DataFrame:
    """The units of the pieces, read from one of the documents that hold them."""
    fields = ["anchor", "piece", "places", "least", "kinds", "start", "n"]
    wanted = pieces.groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias("wanted"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id")

    def work(batch):
        for part in C.slices(batch, "text"):
            data, off = C.text_bytes(part.column("text"))
            units, first, _ = kind.units(data, off)
            lists = part.column("wanted")
            of = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            got = {f: v for f, v in zip(fields, lists.flatten().flatten())}
            at = first[of] + got["start"].to_numpy()
            size = got["n"].to_numpy() - 1 + kind.window
            raw = units[C.spread(at, size)]
            cells = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size * raw.itemsize)]).astype(np.int64)), pa.py_buffer(raw.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([got["anchor"], got["piece"], got["places"], got["least"], got["kinds"], got["n"], cells], ["anchor", "piece", "places", "least", "kinds", "n", "units"])

    return C.per_batch(texts, work, FETCHED)


def in_shards(pieces: DataFrame, kind: Kind, judge, whole: bool, tasks: int) -> DataFrame:
    """anchor, piece, least, verdict: judge(units, start of each piece, windows of each, places, least) gives an array with
    one value for each window, piece after piece; a block has all pieces of its keys. Unless whole, pieces without a repeat
    are left out, and verdict is null where all windows repeat (and have the same least)."""
    dtype = np.uint8 if kind.name == "bytes" else np.uint64

    def settle(parts):
        table = pa.Table.from_batches(parts).combine_chunks()
        data, off = C.text_bytes(table.column("units").combine_chunks())
        units = np.frombuffer(data.tobytes(), dtype)
        n, places, least = (table.column(c).to_numpy() for c in ("n", "places", "least"))
        verdict = judge(units, off // units.itemsize, n, places, least)
        edges = np.concatenate([[0], np.cumsum(n)])
        low, high = (f.reduceat(verdict, edges[:-1]) for f in (np.minimum, np.maximum))
        raw, edges = verdict.tobytes(), edges * verdict.itemsize
        even = (low == high) & (not whole)
        cells = pa.array([None if e else raw[a:b] for e, a, b in zip(even.tolist(), edges, edges[1:])], pa.binary())
        if kind.name == "bytes":
            keep = (high > 0) | whole
        else:
            keep = (places > 1) | (low < least) | whole
            least = np.where(even, low, least)
        out = pa.RecordBatch.from_arrays([table.column("anchor").combine_chunks(), table.column("piece").combine_chunks(), pa.array(least), cells], ["anchor", "piece", "least", "verdict"])
        return out.filter(pa.array(keep))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            key = batch.column("anchor").to_numpy()
            data, off = C.text_bytes(batch.column("units"))
            begin = 0
            turns = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
            if held and len(key) and held[-1].column("anchor")[-1].as_py() != key[0] and size >= BLOCK:
                yield settle(held)
                held, size = [], 0
            for t in turns[:-1]:
                if size + (off[t] - off[begin]) // np.dtype(dtype).itemsize >= BLOCK:
                    yield settle([*held, batch.slice(begin, t - begin)])
                    held, size, begin = [], 0, int(t)
            if len(key) > begin:
                held.append(batch.slice(begin))
                size += (off[-1] - off[begin]) // np.dtype(dtype).itemsize
        if held:
            yield settle(held)

    dealt = pieces.select("anchor", "piece", "places", "least", "n", "units").repartition(tasks, "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "anchor long, piece long, least long, verdict binary")


PART = "anchor long, piece long, nth int, part_anchor long, part long, places long, least long, n int, at int, units binary"


def parts_of(pieces: DataFrame, kind: Kind, width: int, level: int) -> DataFrame:
    """The parts (part_anchor, part) of pieces: their windows from nth on that have one place of the gram, at units from the
    part's begin, and whose distances to it lie in one range of width distances."""
    dtype = np.uint8 if kind.name == "bytes" else np.uint64
    w, m = kind.window, kind.window - kind.gram

    def work(batch):
        step = max(1, (1 << 15) // kind.longest)
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            data, off = C.text_bytes(part.column("units"))
            units, first = np.frombuffer(data.tobytes(), dtype), off // np.dtype(dtype).itemsize
            key, n = part.column("anchor").to_numpy().view(C.U64), part.column("n").to_numpy()
            piece = np.repeat(np.arange(len(n)), n)
            window = C.spread(first[:-1], n)
            if level:
                place = (first[:-1] + part.column("at").to_numpy())[piece]
            else:
                places = kind.places(units, first, key)
                place = places[np.searchsorted(places, window)]
            span = (place - window) // width
            new = np.ones(len(window), bool)
            new[1:] = (piece[1:] != piece[:-1]) | (place[1:] != place[:-1]) | (span[1:] != span[:-1])
            run = np.flatnonzero(new)
            count = np.diff(np.append(run, len(window)))
            window, place, span, of = window[run], place[run], span[run], piece[run]
            hashed = kind.hashes(units)
            context = hashed(place - span * width, place - np.minimum(span * width + width - 1, m) + w)
            size = count - 1 + w
            raw = units[C.spread(window, size)]
            cells = pa.Array.from_buffers(pa.large_binary(), len(run), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size * raw.itemsize)]).astype(np.int64)), pa.py_buffer(raw.tobytes())]).cast(pa.binary())
            own = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [part.column("anchor").take(own), part.column("piece").take(own), pa.array((window - first[of]).astype(np.int32)), pa.array(C.mix(context ^ C.mix(span.astype(C.U64) * C.U64(8) + C.U64(level))).view(np.int64)), pa.array(hashed(window, window + size).view(np.int64)),
                 part.column("places").take(own), part.column("least").take(own), pa.array(count.astype(np.int32)), pa.array((place - window).astype(np.int32)), cells],
                ["anchor", "piece", "nth", "part_anchor", "part", "places", "least", "n", "at", "units"],
            )

    return C.per_batch(pieces, work, PART)


def crowded(pieces: DataFrame, kind: Kind, judge, width: int, level: int = 0) -> DataFrame:
    """anchor, piece, least, verdict of pieces whose keys have too many: the verdicts of their parts in a row."""
    width = -(-width // WAYS)
    parts = C.written(parts_of(pieces, kind, width, level), "parts")
    same = parts.groupBy("part_anchor", "part").agg(F.sum("places").alias("places"), F.min("least").alias("least"), F.max(F.struct("n", "at", "units")).alias("one"))
    same = C.written(same.select(F.col("part_anchor").alias("anchor"), F.col("part").alias("piece"), "places", "least", "one.n", "one.at", "one.units"), "same")
    kinds = same.groupBy("anchor").agg(F.count("*").alias("kinds"))
    judged = settled(C.written(same.join(kinds, "anchor"), "kinds"), kind, judge, True, width, level + 1)
    judged = C.written(judged.select(F.col("anchor").alias("part_anchor"), F.col("piece").alias("part"), "verdict"), "verdicts")
    rows = parts.select("anchor", "piece", "nth", "least", "part_anchor", "part").join(judged, ["part_anchor", "part"])
    lists = rows.groupBy("anchor", "piece").agg(F.min("least").alias("least"), F.array_sort(F.collect_list(F.struct("nth", "verdict"))).alias("vs"))
    return lists.select("anchor", "piece", "least", F.expr("aggregate(vs, cast('' as binary), (a, x) -> concat(a, x.verdict))").alias("verdict"))


def settled(pieces: DataFrame, kind: Kind, judge, whole: bool, width: int, level: int = 0) -> DataFrame:
    """anchor, piece, least, verdict of pieces with all others of their keys: in shards, or split where a key has too many.
    width: distances that a range has so far; of one distance no key has two pieces. In prose a key's pieces grow with the
    table, and so does what a task takes: a fixed number alone would split more and more of all keys."""
    rows, size = pieces.agg(F.count("*"), F.sum(F.octet_length("units"))).first()
    tasks = max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), (size or 0) >> 26)
    crowd = max(CROWD, min(rows // (tasks * OF_TASK), BLOCK // (OF_BLOCK * (kind.longest + kind.window))))
    many = pieces.filter((F.col("kinds") > crowd) & F.lit(width > 1))
    few = in_shards(pieces.filter((F.col("kinds") <= crowd) | F.lit(width <= 1)), kind, judge, whole, tasks)
    return few if width <= 1 or many.isEmpty() else few.unionByName(crowded(many, kind, judge, width, level))


def verdicts(docs: DataFrame, found: DataFrame, kind: Kind, judge) -> DataFrame:
    """anchor, piece, least, verdict (null: all windows) of the pieces that hold a repeated window."""
    pieces = distinct_pieces(found)
    able = (F.col("kinds") > 1) | (F.col("places") > 1)
    units = C.written(fetched(docs, pieces.filter(able | F.col("twice") if "twice" in pieces.columns else able), kind), "units")
    return C.written(settled(units, kind, judge, False, kind.window - kind.gram + 1), "judged")


def hits(docs: DataFrame, found: DataFrame, judged: DataFrame, needed=None) -> DataFrame:
    """docs with hits: the list of its pieces that may lose windows (start, n, least, verdict)."""
    mentions = found.select("anchor", "piece", "doc_id", "start", "n").join(judged, ["anchor", "piece"])
    lists = (mentions if needed is None else mentions.filter(needed)).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "least", "verdict")).alias("hits"))
    lists = C.written(lists.withColumnRenamed("doc_id", "hit_id"), "hits")
    return docs.join(lists, docs["doc_id"].cast("long") == lists["hit_id"], "left").drop("hit_id")


def hit_lists(batch: pa.RecordBatch) -> list:
    """For each row its hits as (starts, numbers of windows, least, verdicts) or None."""
    lists = batch.column("hits")
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, n, least, verdict = lists.flatten().flatten()
    start, n, least, verdict = start.to_numpy(), n.to_numpy(), least.to_numpy(), verdict.to_pylist()
    ends = np.cumsum(size)
    return [(start[a:b], n[a:b], least[a:b], verdict[a:b]) if b > a else None for a, b in zip(ends - size, ends)]

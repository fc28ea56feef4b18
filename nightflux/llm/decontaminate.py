"""Benchmark decontamination: documents that hold windows of benchmark items.

Method: training suffix arrays. A shard of documents gets an array of its suffixes that begin like any test suffix, in
order of their words; every test suffix is looked up in it by binary search, word by word, which gives all places where
its window stands. Places that follow each other in an item and a document join to the longest verbatim match.
Documents never leave their partition; the test suffixes, whose size is checked, are broadcast, in several turns where
they are too many for one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes of benchmark text that are held on the driver and broadcast at a time.
BROADCAST_BYTES = 8 << 20
_SLOTS = 22
_NONE = C.U64(0)


def _tokens(column: pa.Array):
    data, off = C.text_bytes(column)
    data = C.LOWER[data]
    s, e, first = C.words(data, off, C.ALNUM)
    return C.word_hashes(data, s, e) | C.U64(1), first


class TestSuffixes:
    """Different windows of the items: their words, how many words count, and which item has which at which place."""

    __test__ = False

    def __init__(self, ids: list, texts: list, window: int):
        h, first = _tokens(pa.array(texts, pa.string()))
        n = np.diff(first)
        count = np.where(n >= window, n - window + 1, np.minimum(n, 1))
        item = np.repeat(np.arange(len(n)), count)
        place = C.spread(np.zeros(len(n), np.int64), count)
        at = first[item] + place
        depth = np.minimum(n[item], window)
        rows = np.where(np.arange(window)[None, :] < depth[:, None], np.append(h, np.zeros(window, C.U64))[at[:, None] + np.arange(window)], _NONE)
        self.rows, back = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows.reshape(0, window), np.zeros(0, np.int64))
        back = back.reshape(-1)
        self.depth = (self.rows != _NONE).sum(axis=1)
        order = np.argsort(back, kind="stable")
        self.item, self.place = item[order], place[order]
        self.of = np.searchsorted(back[order], np.arange(len(self.rows) + 1))
        self.ids = ids
        self.window = window
        self.lengths = np.minimum(n, window)
        self.single = self._slots(self.rows[self.depth == 1, 0])
        self.double = self._slots(C.grams(self.rows[self.depth > 1, :2].reshape(-1), 2)[::2])

    @staticmethod
    def _slots(h: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << _SLOTS, bool)
        table[(h >> C.U64(64 - _SLOTS)).astype(np.int64)] = True
        return table

    def begins(self, h: np.ndarray) -> np.ndarray:
        """Places of h where a suffix begins as a test suffix does."""
        slot = lambda x: (x >> C.U64(64 - _SLOTS)).astype(np.int64)
        hit = self.single[slot(h)]
        hit[: max(0, len(h) - 1)] |= self.double[slot(C.grams(h, 2))]
        return np.flatnonzero(hit)

    def find(self, h: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of test suffixes and places where they stand; end: where the text of each place ends."""
        at = self.begins(h)
        if not len(at) or not len(self.rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        padded = np.append(h, np.zeros(self.window, C.U64))
        columns = [np.where(at + j < end[at], padded[at + j], _NONE) for j in range(self.window)]
        array = np.lexsort(columns[::-1])
        columns = [c[array] for c in columns]
        test = np.arange(len(self.rows))
        lo, hi = np.searchsorted(columns[0], self.rows[:, 0]), np.searchsorted(columns[0], self.rows[:, 0], side="right")
        done: list = []
        for d in range(1, self.window + 1):
            live = lo < hi
            test, lo, hi = test[live], lo[live], hi[live]
            over = self.depth[test] == d
            done.append((test[over], lo[over], hi[over]))
            test, lo, hi = test[~over], lo[~over], hi[~over]
            if not len(test):
                break
            lo, hi = self._bound(columns[d], self.rows[test, d], lo, hi, False), self._bound(columns[d], self.rows[test, d], lo, hi, True)
        test, lo, hi = (np.concatenate(x) for x in zip(*done))
        return np.repeat(test, hi - lo), at[array[C.spread(lo, hi - lo)]]

    @staticmethod
    def _bound(column, value, lo, hi, after: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            seen = column[np.minimum(mid, len(column) - 1)]
            right = open_ & ((seen <= value) if after else (seen < value))
            lo = np.where(right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)
        return lo


FOUND = "doc_id long, row_key string, n_words long, hit array<struct<first:int,words:int>>, matches array<struct<item_id:long,first:int,words:int>>"


def _spans(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]]).astype(np.int8)))
    return [{"first": int(a), "words": int(z - a)} for a, z in zip(edge[::2], edge[1::2])]


def _search(docs: DataFrame, shared) -> DataFrame:
    """shared: a broadcast of TestSuffixes."""

    def work(batch):
        own = shared.value
        for part in C.slices(batch, "text"):
            h, first = _tokens(part.column("text"))
            n = np.diff(first)
            test, at = own.find(h, np.repeat(first[1:], n))
            hit = C.covered(len(h), at, at + own.depth[test])
            size = own.of[test + 1] - own.of[test]
            pick = C.spread(own.of[test], size)
            item, place, at = own.item[pick], own.place[pick], np.repeat(at, size)
            order = np.lexsort((at, at - place, item))
            item, place, at = item[order], place[order], at[order]
            doc = np.searchsorted(first, at, side="right") - 1
            new = np.ones(len(at), bool)
            new[1:] = (item[1:] != item[:-1]) | (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1] + 1) | (doc[1:] != doc[:-1])
            begin = np.flatnonzero(new)
            long = np.diff(np.append(begin, len(at))) - 1
            best: dict = {}
            for d, i, a, k in zip(doc[begin].tolist(), item[begin].tolist(), at[begin].tolist(), long.tolist()):
                words = k + int(own.lengths[i])
                if words > best.get((d, i), (0, 0))[1]:
                    best[d, i] = (a - int(first[d]), words)
            matches: list[list] = [[] for _ in n]
            for (d, i), (a, words) in sorted(best.items()):
                matches[d].append({"item_id": own.ids[i], "first": a, "words": words})
            touched = np.zeros(len(n), bool)
            touched[doc] = True
            spans = [_spans(hit[first[d] : first[d + 1]]) if touched[d] else [] for d in range(len(n))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), pa.array(n), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))), pa.array(matches, pa.list_(pa.struct([("item_id", pa.int64()), ("first", pa.int32()), ("words", pa.int32())])))], ["doc_id", "row_key", "n_words", "hit", "matches"])

    return C.per_batch(docs, work, FOUND)


def find_items(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, hit (runs of words inside windows of items) and matches (for each item with a window in the
    document its longest verbatim match). One row for each row of docs.

    Null and empty texts have no words, and items of no words no window; an item of fewer words than a window is one.
    Items that are repeated are listed once; an item without item_id hits but is not listed. Rows that are repeated get
    a row each.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    turns = -(-size // BROADCAST_BYTES) or 1
    same = F.md5(F.col("text").cast("binary")) if turns > 1 else F.lit("")  # equal rows find the same in each turn
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), same.alias("row_key"), "text")
    parts = []
    for turn in range(turns):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(turns)) == turn).collect()
        shared = docs.sparkSession.sparkContext.broadcast(TestSuffixes([r.item_id for r in rows], [r.text for r in rows], window))
        found = _search(docs, shared)
        if turns == 1:
            return found.drop("row_key")
        parts.append(C.written(found, "turn"))
        shared.destroy()  # one block at a time
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    joined = whole.groupBy("doc_id", "row_key", "n_words").agg(F.flatten(F.collect_list("hit")).alias("hit"), F.flatten(F.collect_list("matches")).alias("matches"), F.count("*").alias("copies"))
    united = F.expr(
        "aggregate(array_sort(hit), cast(array() as array<struct<first:int,words:int>>), (a, x) -> case when size(a) > 0 and element_at(a, -1).first + element_at(a, -1).words >= x.first"
        " then concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'words', greatest(element_at(a, -1).words, x.first + x.words - element_at(a, -1).first)))) else concat(a, array(x)) end)"
    )
    return joined.select("doc_id", "n_words", united.alias("hit"), F.array_distinct("matches").alias("matches"), F.explode(F.sequence(F.lit(1), (F.col("copies") / turns).cast("int")))).drop("col")


def digests(found: DataFrame) -> DataFrame:
    ids = F.array_sort(F.array_distinct(F.transform(F.filter("matches", lambda m: m.item_id.isNotNull()), lambda m: m.item_id.cast("string"))))
    n_hit = F.aggregate("hit", F.lit(0).cast("long"), lambda a, x: a + x.words)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs that hold no window of an item; rows without doc_id stay."""
    dirty = find_items(docs.filter("doc_id is not null"), items, window).filter(F.size("hit") > 0).select(F.col("doc_id").alias("__dirty")).distinct()
    return docs.join(C.written(dirty, "contaminated"), F.col("doc_id") == F.col("__dirty"), "left_anti")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return digests(find_items(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")))


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents), i AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
s AS (SELECT item_id, list_slice(w, p, p + 9) AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
k AS (SELECT DISTINCT len(win) AS n FROM s),
h AS (SELECT DISTINCT doc_id, p, x.n, item_id FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, k WHERE len(w) >= n) x JOIN s ON s.win = list_slice(x.w, x.p, x.p + x.n - 1)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""

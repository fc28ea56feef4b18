"""Periodic run detection: stretches of words that repeat with a fixed lag, and texts without the repeats.

Method: recursive frequency splitting. Each word of a run of at least times periods stands in it at least times times, so
a word that is rarer within its segment belongs to no run and splits the segment; what is left is counted anew until
nothing splits any more. The surviving segments are scanned lag by lag, up to a times-th of their length. At lag q only
multiples of q are looked at: a run of at least four periods holds three equal blocks in a row that begin there; where
such blocks are found, the run is followed word by word to both ends. Blocks within a run that is known already repeat its
period and are passed over, so the scan takes n log n steps and not n squared.

A text is worked on by itself: there is no shuffle, and a common text or a common word is no burden.
"""

from __future__ import annotations

import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: A run has at least so many periods and so many words.
TIMES, LEAST = 4, 6


def segments(word: np.ndarray, edges: np.ndarray, times: int = TIMES, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the segments of texts (edges: first word of each text, and the number of words) in which each word
    occurs at least times times."""
    size = np.diff(edges)
    starts, ends = edges[:-1][size >= least], edges[1:][size >= least]
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(starts):
        at = C.spread(starts, ends - starts)
        of = np.repeat(np.arange(len(starts)), ends - starts)
        order = np.lexsort((word[at], of))
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(of[order]) != 0) | (word[at][order][1:] != word[at][order][:-1])
        group = np.cumsum(new) - 1
        rare = np.zeros(len(at), bool)
        rare[order] = np.bincount(group)[group] < times
        split = np.bincount(of[rare], minlength=len(starts)) > 0
        done.append((starts[~split], ends[~split]))
        keep = ~rare & split[of]
        at, of = at[keep], of[keep]
        if not len(at):
            break
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(of) != 0)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])
        long = last - first >= least
        starts, ends = at[first[long]], at[last[long] - 1] + 1
    a = np.concatenate([s for s, _ in done] or [np.zeros(0, np.int64)])
    b = np.concatenate([e for _, e in done] or [np.zeros(0, np.int64)])
    return a, b


def same(word: np.ndarray, at: int, lag: int, step: int, stop: int) -> int:
    """How many words in a row from at, one step (1 or -1) after the other and before stop, equal the one lag further."""
    n, block = 0, 64
    while (left := (stop - at) * step - n) > 0:
        m = min(block, left)
        i = at + step * np.arange(n, n + m)
        if len(wrong := np.flatnonzero(word[i] != word[i + lag])):
            return n + int(wrong[0])
        n, block = n + m, block * 4
    return n


def runs(word: np.ndarray, edges: np.ndarray, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period; word: a number for each word, equal for equal words only."""
    starts, ends = segments(word, edges, times, least)
    order = np.argsort(starts - ends, kind="stable")  # longest first: lags of which only some are short enough need a prefix
    starts, size = starts[order], (ends - starts)[order]
    begin = np.cumsum(size + 1) - (size + 1)
    line = -1 - np.arange(int((size + 1).sum()))  # between two segments stands a number of its own
    line[C.spread(begin, size)] = word[C.spread(starts, size)]
    sums = C.prefix_hash(line.astype(np.uint64))
    reach = np.zeros(len(line), np.int64)  # the end of a run that covers the place
    found = []
    for q in range(1, int(size[0]) // times + 1 if len(size) else 0):
        n = int((size + 1)[: np.searchsorted(-size, -max(least, times * q), side="right")].sum())
        block = np.arange(0, n - q, q)
        h = C.span_hash(sums, block, block + q)
        alike = h[1:] == h[:-1]
        chain = times - 2  # a run of so many periods holds so many pairs of equal whole blocks in a row
        if len(alike) < chain:
            continue
        hit = np.flatnonzero(np.logical_and.reduce([alike[i : len(alike) - chain + 1 + i] for i in range(chain)])) * q
        end = 0
        for a in hit[reach[hit] < hit + 2 * q].tolist():
            if a < end:
                continue
            left = same(line, a - 1, q, -1, -1)
            s, e = a - left, a + same(line, a, q, 1, n - q) + q
            end = e - q
            if e - s >= max(least, times * q):
                np.maximum(reach[s:e], e, out=reach[s:e])
                found.append((s, e - s, q))
    if not found:
        return []
    s, length, q = np.array(found).T
    k = np.searchsorted(begin, s, side="right") - 1
    return sorted(zip((s - begin[k] + starts[k]).tolist(), length.tolist(), q.tolist()), key=lambda r: (r[0], r[2]))


RUNS = "array<struct<start:long,length:long,period:long>>"


def collapse(docs: DataFrame, times: int = TIMES, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, n_dropped, runs (start in words, length and period; by start, then period), strongest (the one with the
    most periods; ties: least start, then least period; null without runs) and kept_text (words joined by one space, without
    those that a run holds after its first period).

    Words are runs of characters but space, tab and line ends. A run is a stretch with the smallest period p, of at least
    times periods and least words, that no neighbouring word continues. Null and empty texts have no words and an empty
    kept_text. Rows that are repeated get a row each, also those without doc_id; other columns of docs don't matter. A
    long text is one row of work, in memory of a few times its size. times is 3 at least.
    """
    if times < 3:
        raise ValueError("times must be 3 at least")

    def work(batch):
        for part in C.slices(batch, "text"):
            data, off = C.text_bytes(part.column("text"))
            s, e, first = C.words(data, off, C.NOT_SPACE)
            word = np.unique(C.word_hashes(data, s, e), return_inverse=True)[1]
            of_text = [[] for _ in range(part.num_rows)]
            for start, length, period in runs(word, first, times, least):
                i = int(np.searchsorted(first, start, side="right")) - 1
                of_text[i].append((start - int(first[i]), length, period))
            raw, kept, lost = data.tobytes(), [], []
            for i, own in enumerate(of_text):
                a, n = int(first[i]), int(first[i + 1] - first[i])
                gone = C.covered(n, np.array([x + p for x, _, p in own], np.int64), np.array([x + k for x, k, _ in own], np.int64))
                keep = np.flatnonzero(~gone) + a
                kept.append(b" ".join([raw[x:y] for x, y in zip(s[keep].tolist(), e[keep].tolist())]).decode())
                lost.append(int(gone.sum()))
            as_row = lambda r: {"start": r[0], "length": r[1], "period": r[2]}
            best = [min(own, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2])) if own else None for own in of_text]
            kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            columns = [part.column("doc_id"), pa.array(np.diff(first)), pa.array(lost, pa.int64()), pa.array([[as_row(r) for r in own] for own in of_text], pa.list_(kind)), pa.array([b and as_row(b) for b in best], kind), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_dropped", "runs", "strongest", "kept_text"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return C.per_batch(texts, work, f"doc_id long, n_words long, n_dropped long, runs {RUNS}, strongest struct<start:long,length:long,period:long>, kept_text string")


def with_planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; in every tenth document, by the crc32 of its doc_id, the words from some place on repeat those that
    begin there (text is then words joined by one space)."""

    def planted(doc_id, text):
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 or doc_id is None or not text:
            return text
        data = np.frombuffer(text.encode(), np.uint8)
        s, e, _ = C.words(data, np.array([0, len(data)]), C.NOT_SPACE)
        n, g, raw = len(s), h // 10, data.tobytes()
        if not n:
            return text
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at = np.concatenate([np.arange(a), a + np.arange(n - a) % p])
        return b" ".join([raw[x:y] for x, y in zip(s[at].tolist(), e[at].tolist())]).decode()

    def work(batch):
        ids = batch.column("doc_id")
        yield pa.RecordBatch.from_arrays([ids, pa.array(map(planted, ids.to_pylist(), batch.column("text").to_pylist()), pa.string())], ["doc_id", "text"])

    return C.per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, text string")


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs and collapsed texts of all documents, with the planted ones."""
    done = collapse(with_planted(C.table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("strongest")
    return done.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("strongest.length * 1000 div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("collapsed_sha256"),
    )


OP11_SQL = r"""
WITH o AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, CAST(doc_id AS VARCHAR) AS id FROM documents),
t AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) AS r(i))),
h AS (SELECT doc_id, w, len(w) AS n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(id, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: xor(c // 256, crc[1 + xor(c, b) % 256])), 4294967295) AS h FROM o, t),
g AS (SELECT doc_id, w, n, h % 10 = 0 AND n > 0 AS planted, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a, 3 + (h // 10) % 8 AS k FROM h),
v AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END]) ELSE w END AS w FROM g),
x AS MATERIALIZED (SELECT doc_id, n, i, hash(w[1 + i]) AS word FROM v, LATERAL (SELECT unnest(range(n)) AS i)),
e AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM x l JOIN x r ON l.doc_id = r.doc_id AND l.word = r.word AND r.i > l.i AND 4 * (r.i - l.i) <= l.n),
s AS (SELECT doc_id, q, min(i) AS a, max(i) + 1 + q AS z FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM e) GROUP BY doc_id, q, isle),
c AS MATERIALIZED (SELECT doc_id, q, a, z FROM s WHERE z - a >= greatest(6, 4 * q)),
r AS MATERIALIZED (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.doc_id = c.doc_id AND d.q < c.q AND d.a <= c.a AND d.z >= c.z)),
b AS (SELECT doc_id, a, z - a AS length, q FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(z - a AS DOUBLE) / q DESC, a, q) = 1),
m AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(a, ',', z - a, ',', q, chr(10)), '' ORDER BY a, q) AS lines FROM r GROUP BY doc_id),
k AS (SELECT DISTINCT doc_id, unnest(range(a + q, z)) AS i FROM r),
y AS (SELECT v.doc_id, i, w[1 + i] AS word FROM v, LATERAL (SELECT unnest(range(n)) AS i)),
f AS (SELECT y.doc_id, string_agg(word, ' ' ORDER BY y.i) AS kept FROM y LEFT JOIN k ON y.doc_id = k.doc_id AND y.i = k.i WHERE k.i IS NULL GROUP BY y.doc_id)
SELECT v.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(b.a AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length, CAST(b.q AS BIGINT) AS period, CAST(1000 * b.length // b.q AS BIGINT) AS exponent_milli,
sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM v LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN f USING (doc_id)
"""

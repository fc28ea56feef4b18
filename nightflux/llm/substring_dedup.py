"""Substring dedup: words covered by a window of 13 words that an earlier document has too.

Method: compressed FM-index per shard. A shard holds the different pieces (see anchored) of some keys; each piece is
streamed through the shard's index by backward search over the wavelet matrix, which gives its matching statistics up to
the window length; where they reach it, the range of the suffix array tells the least doc_id that has the window.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchored as A
from . import common as C
from .indexes import FMIndex


def least_ids(window: int):
    """Judge of a shard: for each window the least doc_id of the pieces that hold it."""

    def judge(units, first, n, places, least):
        _, sym = np.unique(units, return_inverse=True)
        size = np.diff(first)
        of = np.repeat(np.arange(len(size)), size + 1)
        seq = np.zeros(len(units) + len(size), np.int64)
        begin = first[:-1] + np.arange(len(size))
        seq[C.spread(begin, size)] = sym + 1
        index = FMIndex(seq, window)
        at = C.spread(begin, n)
        out = least[of[at]]
        matched, lo, hi = index.search(seq, at, window)
        many = np.flatnonzero((matched == window) & (hi - lo > 1))
        if len(many):
            ranges, back = np.unique(lo[many] * (index.n + 1) + hi[many], return_inverse=True)
            ends = np.column_stack([ranges // (index.n + 1), ranges % (index.n + 1)]).ravel()
            ids = np.append(least[of[index.sa]], np.iinfo(np.int64).max)
            out[many] = np.minimum.reduceat(ids, ends)[::2][back]
        return out

    return judge


def remove_repeats(docs: DataFrame, window: int = 13, gram: int = 3) -> DataFrame:
    """docs (doc_id, text, ...) with n_words, n_removed, kept_text and spans.

    Words are runs of characters but space, tab and line ends. Each word is removed that a window covers which also
    starts in a document with a smaller doc_id. spans: the removed runs as (first word, words). Null and empty texts
    have no words and an empty kept_text. A row without doc_id keeps all its words and takes part in no match. Rows that
    are repeated whole have one doc_id, so they remove nothing from each other and get the same result.
    """
    kind = A.Kind("words", window, gram, 64)
    found = A.repeated(docs, kind, within=False)
    judged = A.verdicts(docs, found, kind, least_ids(window))
    marked = A.hits(docs.select("doc_id", "text"), found, judged, (F.col("least") < F.col("doc_id")) | F.col("verdict").isNotNull())

    def work(batch):
        for part in C.slices(batch, "text"):
            data, off = C.text_bytes(part.column("text"))
            s, e, first = C.words(data, off, C.NOT_SPACE)
            raw, out = data.tobytes(), []
            for d, hit in zip(part.column("doc_id").to_pylist(), A.hit_lists(part)):
                i = len(out)
                a, b = first[i], first[i + 1]
                gone = np.zeros(b - a, bool)
                if hit is not None:
                    start, n, least, verdict = hit
                    lost = [np.arange(x, x + k)[(np.frombuffer(v, np.int64) if v is not None else np.full(k, m)) < d] for x, k, m, v in zip(start, n, least, verdict)]
                    lost = np.concatenate(lost)
                    gone = C.covered(b - a, lost, lost + window)
                keep = np.flatnonzero(~gone) + a
                kept = b" ".join([raw[x:y] for x, y in zip(s[keep].tolist(), e[keep].tolist())])
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(np.int8)))
                out.append((int(b - a), int(gone.sum()), kept.decode(), [(int(x), int(y - x)) for x, y in zip(edge[::2], edge[1::2])]))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array([[{"first": f, "words": w} for f, w in r] for r in cols[3]], pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())])))], ["doc_id", "n_words", "n_removed", "kept_text", "spans"])

    return C.per_batch(marked, work, "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<first:int,words:int>>")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    kept = remove_repeats(C.table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 12), ' ')) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
m AS (SELECT win, min(doc_id) AS least FROM s GROUP BY win),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM s JOIN m USING (win) WHERE least < doc_id),
a AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
k AS (SELECT a.doc_id, count(*) FILTER (g.p IS NOT NULL) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY a.p) FILTER (g.p IS NULL), '') AS kept FROM a LEFT JOIN g ON a.doc_id = g.doc_id AND a.p = g.p GROUP BY a.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

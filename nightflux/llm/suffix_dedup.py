"""Suffix-array dedup: bytes covered by a string of 400 bytes that also starts anywhere else.

Method: threshold-bounded interval expansion. A shard holds the different pieces (see anchored) of some keys; on its
Burrows-Wheeler transform the intervals are extended to the left breadth first, which derives the common prefixes of
neighbouring suffixes by increasing value and stops at the least length that counts. Suffixes that no boundary
separates then share at least that many bytes. The transform is held as runs of equal symbols, so an interval that one
byte alone precedes is one lookup, and any other costs its runs.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchored as A
from . import common as C
from .indexes import RunIndex


def starts_again(window: int):
    """Judge of a shard: for each window whether it starts in more than one place."""

    def judge(units, first, n, places, least):
        size = np.diff(first)
        of = np.repeat(np.arange(len(size)), size + 1)
        seq = np.zeros(len(units) + len(size), np.uint16)
        begin = first[:-1] + np.arange(len(size))
        number = np.cumsum(np.bincount(units, minlength=256) > 0)  # of the bytes that occur, from 1
        seq[C.spread(begin, size)] = number[units]
        bits = int(number[-1]).bit_length()
        index = RunIndex(seq, window, 63 // bits, bits)
        at = C.spread(begin, n)
        weight = np.zeros(len(seq), np.int64)
        weight[at] = places[of[at]]
        group = np.cumsum(index.boundaries(window)[:-1]) - 1
        total = np.bincount(group, weight[index.sa])
        again = np.empty(len(seq), bool)
        again[index.sa] = total[group] > 1
        return again[at].astype(np.uint8)

    return judge


def remove_long_repeats(docs: DataFrame, length: int = 400, gram: int = 160) -> DataFrame:
    """docs (doc_id, text, ...) with n_bytes, n_removed, n_spans and kept (the bytes that stay).

    Texts count as UTF-8 bytes. Each byte is removed that a string of length bytes covers which also starts at any other
    place, in the same document or another. Null and empty texts have no bytes. A row without doc_id keeps all its bytes
    and takes part in no match. Rows that are repeated whole are places of their own, so both lose what is long enough.
    """
    kind = A.Kind("bytes", length, gram, 2 * length)
    found = A.repeated(docs, kind, within=True)
    marked = A.hits(docs.select("doc_id", "text"), found, A.verdicts(docs, found, kind, starts_again(length)))

    def work(batch):
        for part in C.slices(batch, "text"):
            data, off = C.text_bytes(part.column("text"))
            out = []
            for i, hit in enumerate(A.hit_lists(part)):
                own = data[off[i] : off[i + 1]]
                if hit is None:
                    out.append((len(own), 0, 0, own.tobytes()))
                    continue
                start, n, least, verdict = hit
                lost = np.concatenate([np.arange(x, x + k)[np.frombuffer(v, np.uint8) > 0] if v is not None else np.arange(x, x + k) for x, k, v in zip(start, n, verdict)])
                gone = C.covered(len(own), lost, np.minimum(lost + length, len(own)))
                spans = int((np.diff(np.concatenate([[0], gone]).astype(np.int8)) > 0).sum())
                out.append((len(own), int(gone.sum()), spans, own[~gone].tobytes()))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return C.per_batch(marked, work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    kept = remove_long_repeats(C.table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

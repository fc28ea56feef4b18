"""Session, table and array helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that goes to Python, and the bytes of text that are held as arrays at a time.
BATCH_ROWS = 500
SLICE_BYTES = 1 << 20

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


# ---------------------------------------------------------------- session and tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a new one where none is set and all tasks run in this
    process (as in tests)."""
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextlib.contextmanager
def settings(spark: SparkSession, **values):
    """Session settings that hold inside the block; names have _ for a dot."""
    names = {k.replace("__", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession) -> None:
    """Long texts: fewer rows in a batch that goes to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """df as a table in the shared folder: later steps survive lost executors without computing it again.

    The shuffle files of the job are deleted when the table is there.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/nightflux/{name}-{uuid.uuid4().hex}"
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def removed(table: DataFrame) -> None:
    """Deletes a table of written that nothing reads any more."""
    if path := table.__dict__.get("table_path"):
        jvm = table.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def per_batch(df: DataFrame, work, schema: str) -> DataFrame:
    """work(record batch) -> record batches, for each Arrow batch of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from work(batch)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about limit bytes; a longer text is a run of its own."""
    size = np.diff(text_bytes(batch.column(column))[1])
    cut = np.cumsum(size) // limit
    edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the offset of each text; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def packed(docs: DataFrame) -> DataFrame:
    """doc_id and text compressed, for joins that shuffle whole texts; null stays null. unpacked undoes it."""
    import zstandard

    def work(batch):
        z = zstandard.ZstdCompressor(level=1, write_content_size=True)
        small = [None if t is None else z.compress(t.encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(small, pa.binary())], ["doc_id", "packed"])

    return per_batch(docs.select("doc_id", "text"), work, "doc_id long, packed binary")


def unpacked(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with text instead of packed, each of about limit bytes."""
    import zstandard

    z, at = zstandard.ZstdDecompressor(), batch.schema.get_field_index("packed")
    begin, held, texts = 0, 0, []
    for i, raw in enumerate(batch.column("packed").to_pylist()):
        texts.append(None if raw is None else z.decompress(raw).decode())
        held += len(texts[-1] or "")
        if held >= limit or i == batch.num_rows - 1:
            yield batch.slice(begin, i + 1 - begin).set_column(at, "text", pa.array(texts, pa.string()))
            begin, held, texts = i + 1, 0, []


# ---------------------------------------------------------------- words


#: Which bytes belong to a word.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words(data: np.ndarray, off: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the number of its first word (one more entry at the end)."""
    inside = of[data]
    first = np.zeros(len(data) + 1, bool)
    first[off[:-1]] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


@functools.lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for base in (BASE, inverse):
        p = np.full(n, base, U64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    size = 1 << max(16, int(n - 1).bit_length()) if n > 1 else 1 << 16
    up, down = _powers(size)
    return up[:n], down[:n]


def prefix_hash(units: np.ndarray) -> np.ndarray:
    """Sums from which span_hash takes the hash of any span."""
    out = np.zeros(len(units) + 1, U64)
    np.cumsum((units.astype(U64) + U64(1)) * powers(len(units))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans: equal spans have equal hashes wherever they stand."""
    h = (prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts]
    return mix(h ^ (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def mix(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads all bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(data), starts, ends)


def hash_word(word: str | bytes) -> int:
    """The hash that word_hashes gives the same bytes."""
    raw = np.frombuffer(word.encode() if isinstance(word, str) else word, np.uint8)
    return int(word_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k hashes in a row; as many as there are whole ones."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= U64(0xFF51AFD7ED558CCD)
        out ^= out >> U64(32)
        out += h[j : j + n]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values in a row."""
    if w <= 1 or len(x) < w:
        return x if w <= 1 else x[:0]
    m, span = x, 1
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = w - span
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at starts."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the spans."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0


def hashed_column(df: DataFrame, text: str = "text") -> DataFrame:
    """df with text_key, equal for equal texts only (128 bits); null where the text is null."""
    return df.withColumn("text_key", F.md5(F.col(text).cast("binary")))

"""Vector code compression: each part of a vector becomes the number of the nearest entry of its position's codebook.

Method: active-entry Lloyd. Each row carries the entry of every part and the exact squared distance to it. After an update
a part whose entry stayed where it was is compared with the entries that moved only, against the stored distance; a part
whose entry moved looks at all entries again. Ties go to the lower index in both cases. Entries are whole numbers, so
distances, sums and the entries themselves are exact.

A round is a table in the shared folder (whole numbers, entries and distances of all rows) and one aggregate of it: sums for
each part and entry, which is all that reaches the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Whole numbers up to this keep all distances of up to 2^9 components below 2^63.
LARGEST = 1 << 26
#: A label of at least one of so many rows counts as hot, so there are so many hot labels at most.
HOT = 1000
STATE = "vec_id long, label {label}, ints binary, code binary, dist binary"


def whole_numbers(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, label, ints (little-endian 64-bit numbers), without rows whose vector is null, empty or holds null, NaN or an
    infinite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    v = F.col(vector).cast("array<double>")
    kept = vectors.select("vec_id", "label", v.alias("v")).filter((F.size("v") > 0) & F.forall("v", finite))

    def work(batch):
        rows = batch.column("v")
        flat = np.floor(np.asarray(rows.flatten(), np.float64) * scale)
        if len(flat) and np.abs(flat).max() > LARGEST:
            raise ValueError(f"a component times {scale} is beyond {LARGEST}: distances would not fit 64 bits")
        raw, size = flat.astype("<i8"), np.asarray(rows.value_lengths())
        at = np.concatenate([[0], np.cumsum(size)])
        ints = [raw[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(ints, pa.binary())], ["vec_id", "label", "ints"])

    return C.per_batch(kept, work, f"vec_id long, label {label_type(vectors)}, ints binary")


def label_type(vectors: DataFrame) -> str:
    return vectors.schema["label"].dataType.simpleString()


def matrix(column: pa.Array, *shape: int) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, "<i8").reshape(len(column), *shape)


def distances(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of parts (rows, width) to entries (n, width)."""
    out = np.zeros((len(parts), len(entries)), np.int64)
    for j in range(parts.shape[1]):
        out += np.square(parts[:, j, None] - entries[None, :, j])
    return out


def assigned(parts: np.ndarray, books: np.ndarray, moved: np.ndarray, code: np.ndarray | None, dist: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Entry and distance of each part; parts: (rows, positions, width), books: (positions, entries, width).

    code and dist are those of the round before (None in the first); moved: the entries that changed since, by position.
    """
    n, positions, _ = parts.shape
    new, far = np.zeros((n, positions), np.uint8), np.zeros((n, positions), np.int64)
    for p in range(positions):
        whole = np.ones(n, bool) if code is None else moved[p][code[:, p]]
        if whole.any():
            d = distances(parts[whole, p], books[p])
            best = d.argmin(axis=1)  # the first of equals
            new[whole, p], far[whole, p] = best, d[np.arange(len(d)), best]
        still = np.flatnonzero(~whole)
        if len(still):
            new[still, p], far[still, p] = code[still, p], dist[still, p]
            if len(active := np.flatnonzero(moved[p])):
                d = distances(parts[still, p], books[p][active])
                first = d.argmin(axis=1)
                least, entry = d[np.arange(len(d)), first], active[first]
                better = (least < dist[still, p]) | ((least == dist[still, p]) & (entry < code[still, p]))
                new[still[better], p], far[still[better], p] = entry[better], least[better]
    return new, far


def assign(state: DataFrame, books: np.ndarray, moved: np.ndarray, first: bool) -> DataFrame:
    """state with code and dist against the codebooks."""
    positions, _, width = books.shape

    def work(batch):
        if not batch.num_rows:
            return
        parts = matrix(batch.column("ints"), positions, width)
        code = dist = None
        if not first:
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, positions)
            dist = matrix(batch.column("dist"), positions)
        new, far = assigned(parts, books, moved, code, dist)
        cols = [pa.array([x.tobytes() for x in new], pa.binary()), pa.array([x.astype("<i8").tobytes() for x in far], pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("ints"), *cols], ["vec_id", "label", "ints", "code", "dist"])

    return C.per_batch(state, work, STATE.format(label=label_type(state)))


def totals(state: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Number of parts of each (position, entry), and their sums by component: summed in each task, then by key."""
    positions, entries, width = shape

    def work(batch):
        if not batch.num_rows:
            return
        parts = matrix(batch.column("ints"), positions, width)
        code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, positions)
        key = code.astype(np.int64) + np.arange(positions) * entries
        sums = np.zeros((positions * entries, width), np.int64)
        np.add.at(sums, key.ravel(), parts.reshape(-1, width))
        count = np.bincount(key.ravel(), minlength=positions * entries)
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(count[seen], pa.int64()), pa.array(sums[seen].tolist(), pa.list_(pa.int64()))], ["key", "n", "sums"])

    partial = C.per_batch(state.select("ints", "code"), work, "key int, n long, sums array<long>")
    rows = partial.groupBy("key").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)]).collect()  # positions * entries rows at most
    count, sums = np.zeros((positions, entries), np.int64), np.zeros(shape, np.int64)
    for r in rows:
        at = divmod(r["key"], entries)
        count[at], sums[at] = r["n"], [r[f"s{j}"] for j in range(width)]
    return count, sums


def learned(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """The rows with code and dist (see STATE), and the codebooks as (position, entry, component).

    Codebooks begin as the parts of the rows with the smallest vec_id (then the smallest numbers; a row without vec_id comes
    last). Fewer rows than entries give codebooks of as many entries; no rows give none. Vectors of another length than the
    very first row's are left out; that length must be a multiple of parts. Rows that are repeated count each.
    """
    base = all_rows = C.written(whole_numbers(vectors, vector, scale), "vectors")
    order = [F.col("vec_id").asc_nulls_last(), "ints", "label"]
    seeds = [r.ints for r in base.orderBy(*order).limit(1).collect()]
    if not seeds:
        return assign(base, np.zeros((parts, 0, 0), np.int64), np.zeros((parts, 0), bool), True), np.zeros((parts, 0, 0), np.int64)
    dims = len(seeds[0]) // 8
    if dims % parts:
        raise ValueError(f"{dims} components can't be cut into {parts} equal parts")
    base = base.filter(F.length("ints") == dims * 8)
    seeds = [np.frombuffer(r.ints, "<i8") for r in base.orderBy(*order).limit(entries).select("ints").collect()]
    books = np.stack(seeds).reshape(len(seeds), parts, dims // parts).transpose(1, 0, 2).copy()
    moved, state = np.ones(books.shape[:2], bool), base
    for done in range(rounds):
        new = C.written(assign(state, books, moved, done == 0), "codes")
        C.removed(all_rows if done == 0 else state)
        state = new
        count, sums = totals(state, books.shape)
        now = np.where(count[:, :, None] > 0, sums // np.maximum(count, 1)[:, :, None], books)
        moved, books = (now != books).any(axis=2), now
        if not moved.any():
            return state, books
    return assign(state, books, moved, rounds == 0), books


def compress(vectors: DataFrame, vector: str = "embedding", **how) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (one byte a part), error (squared distance in whole numbers, summed over parts) and label_error
    (summed over rows with an equal label, nulls together); and the codebooks as (position, entry, component).

    vectors: vec_id, label and the vector column; other columns don't matter. See learned for odd rows.
    """
    state, books = learned(vectors, vector, **how)
    positions, label = books.shape[0], label_type(vectors)

    def work(batch):
        far = matrix(batch.column("dist"), positions).sum(axis=1) if batch.num_rows else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("code"), pa.array(far, pa.int64())], ["vec_id", "label", "code", "error"])

    coded = C.written(C.per_batch(state, work, f"vec_id long, label {label}, code binary, error long"), "coded")
    C.removed(state)
    sums = C.written(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    rows = coded.count()
    hot = F.broadcast(sums.filter(F.col("n") * HOT >= rows).select(F.col("of").alias("hot"), F.col("label_error").alias("hot_error")))
    cold = sums.filter(F.col("n") * HOT < rows).select("of", "label_error")
    first = coded.join(hot, F.col("label").eqNullSafe(F.col("hot")), "left")
    done = first.filter("hot_error is not null").select(*coded.columns, F.col("hot_error").alias("label_error"))
    rest = first.filter("hot_error is null").select(*coded.columns).join(cold, F.col("label").eqNullSafe(F.col("of"))).drop("of")
    return done.unionByName(rest), books


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes, errors and the digest of the codebooks of all embeddings."""
    coded, books = compress(C.table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """Every round rescans all entries: a row for each part and component."""
    steps = [
        f"""e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT vec_id, p, unnest(v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}]) AS x, generate_subscripts(v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}], 1) AS j FROM e, range({parts}) AS t(p))",
        f"s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM e QUALIFY k < {entries})",
        "c0 AS MATERIALIZED (SELECT p, k, j, x AS y FROM p JOIN s USING (vec_id))",
    ]
    for r in range(rounds + 1):
        steps.append(f"d{r} AS (SELECT vec_id, p.p, k, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM p JOIN c{r} c ON p.p = c.p AND p.j = c.j GROUP BY ALL)")
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, k, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, k) = 1)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT p.p, k, j, CAST(sum(x) AS BIGINT) AS t, count(*) AS n FROM p JOIN a{r} a ON p.vec_id = a.vec_id AND p.p = a.p GROUP BY ALL)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT p, k, j, coalesce((t - ((t % n) + n) % n) // n, y) AS y FROM c{r} LEFT JOIN m{r} USING (p, k, j))")
    steps.append(f"f AS (SELECT vec_id, string_agg(format('{{:02x}}', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)")
    books = f"(SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, k, j)) FROM c{rounds})"
    return "WITH " + ",\n".join(steps) + f"\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {books} AS codebooks_sha256 FROM f JOIN e USING (vec_id)\n"


OP13_SQL = _sql()

"""BPE encoding and decoding with content-defined chunk reuse.

Method: a rolling hash cuts each text into chunks, so that equal passages give equal chunks wherever they stand. A chunk
that occurs more than once is encoded once, segment by segment. In a text, the tokens of its shared chunks are put in
place and the joins are repaired: what lies between two reused parts is encoded again together with the last segment of
the part before and the first segment of the part behind, and segment by segment further into the next part, until the
new tokens agree exactly with those of the segments at both ends. A part whose segments never agree is encoded again.

Segments end at places that the byte-level pattern can't go across whatever stands around: before a single space
between two other characters, and before a full stop or comma of East Asian writing. A chunk is put in place only where
its bytes are there. A text that holds the string of a special token is encoded as a whole.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: The byte-level pattern (fixed values of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A chunk ends where the rolling hash of so many bytes has its low bits clear; shorter chunks are not shared.
ROLL, LOW_BITS, SHORTEST = 32, 10, 64

_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Vocabulary file of a byte-level tokenizer: text to ids and back."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self._encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self._allowed = set(self.special)
        self.special_bytes = [t.encode() for t in self.special]
        tokens = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
        for t, i in [*ranks.items(), *((s.encode(), i) for s, i in self.special.items())]:
            tokens[i] = t
        self._size = np.array([len(t) for t in tokens])
        self._at = np.cumsum(self._size) - self._size
        self._bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.dtype = np.uint16 if len(tokens) <= 1 << 16 else np.uint32

    def encode(self, text: str) -> np.ndarray:
        return self._encoding.encode_to_numpy(text, allowed_special=self._allowed, disallowed_special=())

    def decode(self, ids: np.ndarray) -> str:
        ids = ids.astype(np.int64)
        return self._bytes[C.spread(self._at[ids], self._size[ids])].tobytes().decode("utf-8", "replace")


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def chunk_edges(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where chunks begin: at each text and after each place that the rolling hash marks."""
    pre = C.prefix_hash(data)
    n = max(0, len(data) - ROLL + 1)
    h = C.mix((pre[ROLL:] - pre[:n]) * C.powers(n)[1]) if n else np.zeros(0, C.U64)
    cut = np.flatnonzero((h >> C.U64(64 - LOW_BITS)) == 0) + ROLL
    cut = cut[cut - off[np.searchsorted(off, cut, side="right") - 1] >= ROLL]  # the marked bytes lie in one text
    return np.union1d(cut[cut < len(data)], off[:-1][np.diff(off) > 0])


def _key(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def segment_ends(raw: np.ndarray) -> np.ndarray:
    """Places where segments of the bytes end."""
    b = np.concatenate([raw, np.zeros(3, np.uint8)])
    n = len(raw)
    if n < 4:
        return np.zeros(0, np.int64)
    one, two, three = b[:n], b[1 : n + 1], b[2 : n + 2]
    odd = (one == 0xC2) | ((one >= 0xE1) & (one <= 0xE3))  # a character that begins so may be a space
    plain = (one > 0x20) & (one != 0x7F) & ~odd
    ends_odd = np.zeros(n, bool)  # the last byte of such a character
    ends_odd[1:] |= one[:-1] == 0xC2
    ends_odd[2:] |= odd[:-2] & (one[:-2] != 0xC2)
    before = (one > 0x20) & (one != 0x7F) & ~ends_odd & (one < 0xC0)
    space = np.zeros(n, bool)
    space[1:-1] = (one[1:-1] == 0x20) & before[:-2] & plain[2:]
    stop = np.zeros(n, bool)  # an ideograph, then U+3001 or U+3002
    stop[3:] = (one[3:] == 0xE3) & (two[3:] == 0x80) & ((three[3:] == 0x81) | (three[3:] == 0x82)) & (one[:-3] >= 0xE4) & (one[:-3] <= 0xE9)
    return np.flatnonzero(space | stop)


def chunks(docs: DataFrame) -> DataFrame:
    def work(batch):
        for part in C.slices(batch, "text"):
            data, off = C.text_bytes(part.column("text"))
            edges = np.append(chunk_edges(data, off), len(data))
            size = np.diff(edges)
            at, size = edges[:-1][size >= SHORTEST], size[size >= SHORTEST]
            text = np.searchsorted(off, at, side="right") - 1
            raw = data.tobytes()
            keys = [_key(raw[a : a + n]) for a, n in zip(at.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), part.column("doc_id").take(pa.array(text)), pa.array((at - off[text]).astype(np.int32)), pa.array(size.astype(np.int32))], ["key", "doc_id", "start", "size"])

    return C.per_batch(docs, work, "key binary, doc_id long, start int, size int")


#: Segments at the begin of a chunk that a join may go into, one after the other.
TRIED = 4


def in_segments(own: Codec, raw: np.ndarray) -> tuple[list[int], list[int], bytes] | None:
    """Segment ends of a chunk (the first ones, and the last two), how many tokens stand before each, and its tokens from the
    first to the last end. None if it has too few."""
    ends = segment_ends(raw)
    if len(ends) < 4:
        return None
    ends = [*ends[: TRIED + 1].tolist(), *ends[TRIED + 1 :][-2:].tolist()]
    ids = [own.encode(raw[a:z].tobytes().decode()) for a, z in zip(ends, ends[1:])]
    return ends, np.cumsum([0, *map(len, ids)]).tolist(), np.concatenate(ids).astype(own.dtype).tobytes()


def encoded_once(docs: DataFrame, shared: DataFrame, path: str) -> DataFrame:
    """key, ends, before, ids: the tokens of each shared chunk, as in_segments gives them."""
    wanted = shared.groupBy("doc_id").agg(F.collect_list(F.struct("key", "start", "size")).alias("wanted"))
    texts = C.packed(docs).join(wanted.withColumnRenamed("doc_id", "wanted_id"), F.col("doc_id") == F.col("wanted_id")).select("packed", "wanted")

    def work(batch):
        own = codec(path)
        for part in C.unpacked(batch):
            data, off = C.text_bytes(part.column("text"))
            out = []
            for i, wanted in enumerate(part.column("wanted").to_pylist()):
                for w in wanted:
                    raw = data[off[i] + w["start"] : min(off[i] + w["start"] + w["size"], off[i + 1])]
                    if _key(raw.tobytes()) == w["key"] and (c := in_segments(own, raw)):
                        out.append((w["key"], *c))
            cols = list(zip(*out)) or [[]] * 4
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], ints), pa.array(cols[2], ints), pa.array(cols[3], pa.binary())], ["key", "ends", "before", "ids"])

    return C.per_batch(texts, work, "key binary, ends array<int>, before array<int>, ids binary")


def assemble(own: Codec, raw: bytes, placed: list | None) -> tuple[np.ndarray, int]:
    """Ids of the text: reused ones in place, and the joins encoded again until both sides agree; and the bytes reused."""
    if any(t in raw for t in own.special_bytes):
        return own.encode(raw.decode()).astype("<u4"), 0
    parts, done, reused = [], 0, 0  # tokens up to the byte done
    held = np.zeros(0, own.dtype)  # tokens of the segment before the join, which begins at done
    for p in sorted(placed or (), key=lambda p: p["start"]):
        at, ends, before, ids = p["start"], p["ends"], p["before"], np.frombuffer(p["ids"], own.dtype)
        if at + ends[0] < done or _key(raw[at : at + p["size"]]) != p["key"]:
            continue
        for i in range(1, min(TRIED, len(ends) - 3) + 1):
            join = own.encode(raw[done : at + ends[i]].decode())
            tail = ids[before[i - 1] : before[i]]
            if len(join) >= len(held) + len(tail) and (join[: len(held)] == held).all() and (join[len(join) - len(tail) :] == tail).all():
                last = len(ends) - 2
                parts += [join, ids[before[i] : before[last]]]
                reused += ends[last] - ends[i]
                done, held = at + ends[last], ids[before[last] :]
                break
    if done < len(raw):
        rest = own.encode(raw[done:].decode())
        parts.append(rest)
    return np.concatenate(parts).astype("<u4") if parts else np.zeros(0, "<u4"), reused


def encode(docs: DataFrame, path: str | None = None, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, reused (bytes whose tokens come from shared chunks), ids (little-endian unsigned 32-bit numbers), and
    with decoded the text that they decode to.

    Same ids as the tokenizer of the vocabulary file gives without adding special tokens; the strings of special tokens
    in a text are special tokens. Null and empty texts have no tokens. A row without doc_id is encoded for itself.
    Rows that are repeated share chunks like any others, and give a row each.
    """
    path = path or default_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = docs.filter("doc_id is not null and text is not null")
    found = C.written(chunks(named), "chunks")
    shared = found.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "start", "size")).alias("at")).filter("c > 1").select("key", "at.doc_id", "at.start", "at.size")
    once = C.written(encoded_once(named, shared, path), "encoded")
    placed = found.join(once, "key").groupBy("doc_id").agg(F.collect_set(F.struct("key", "start", "size", "ends", "before", "ids")).alias("placed")).withColumnRenamed("doc_id", "placed_id")
    whole = C.packed(docs).join(placed, F.col("doc_id") == F.col("placed_id"), "left").drop("placed_id")

    def work(batch):
        own = codec(path)
        for part in C.unpacked(batch):
            data, off = C.text_bytes(part.column("text"))
            raw = data.tobytes()
            both = [assemble(own, raw[off[i] : off[i + 1]], part.column("placed")[i].as_py()) for i in range(part.num_rows)]
            ids = [x for x, _ in both]
            cols = [part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([r for _, r in both], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
            names = ["doc_id", "n_tokens", "reused", "ids"]
            if decoded:
                cols.append(pa.array([own.decode(x) for x in ids], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(cols, names)

    return C.per_batch(whole, work, "doc_id long, n_tokens long, reused long, ids binary" + (", decoded string" if decoded else ""))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with decoded, the text of its ids."""
    path = path or default_path()

    def work(batch):
        own = codec(path)
        texts = [own.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    from pyspark.sql import types as T

    return C.per_batch(encoded, work, T.StructType([*(f for f in encoded.schema.fields), T.StructField("decoded", T.StringType())]))


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(encode(C.table(spark, sf_dir, "documents"), decoded=True))

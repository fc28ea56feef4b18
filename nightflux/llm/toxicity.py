"""Toxicity: a counterfactual-regularised classifier.

Method: a logistic model over the words of a text. Besides the labels it learns from counterfactuals: each labelled text
is paired with one in which identity terms are swapped for others of the same kind (a text without any gets a neutral
mention), and the squared change of the score in log-odds is penalised. So a mention of a group does not move a score,
while the wording around it may. The fit runs on a bounded sample of labelled rows; scoring reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Identity terms by language and kind; a term is swapped for another of its kind (fixed values).
IDENTITY = {
    "faith": "muslim christian jewish hindu buddhist sikh atheist catholic protestant islam judaism christianity",
    "faithful": "muslims christians jews hindus buddhists sikhs atheists catholics protestants",
    "gender": "man woman male female boy girl men women boys girls transgender nonbinary",
    "pronoun": "he she",
    "pronoun, object": "him her",
    "pronoun, own": "his hers",
    "orientation": "gay lesbian bisexual straight queer heterosexual homosexual",
    "origin": "black white asian latino african american european arab mexican chinese indian immigrant refugee",
    "origins": "blacks whites asians latinos africans americans europeans arabs mexicans immigrants refugees",
    "ability": "deaf blind disabled autistic",
    "age": "old young elderly teenage",
    "de faith": "muslim christ jude hindu buddhist atheist katholik protestant",
    "de gender": "mann frau junge mädchen männer frauen",
    "de pronoun": "er sie",
    "de pronoun, object": "ihn ihm ihr",
    "de origin": "deutscher türke araber afrikaner europäer ausländer flüchtling",
    "fr faith": "musulman chrétien juif hindou bouddhiste athée catholique protestant",
    "fr gender": "homme femme garçon fille hommes femmes",
    "fr pronoun": "il elle",
    "fr pronouns": "ils elles",
    "fr origin": "français arabe africain européen asiatique étranger réfugié",
    "es faith": "musulmán cristiano judío hindú budista ateo católico protestante",
    "es gender": "hombre mujer niño niña hombres mujeres",
    "es pronoun": "él ella",
    "es pronouns": "ellos ellas",
    "es origin": "español árabe africano europeo asiático extranjero refugiado",
}
#: Rows of the sample, words of the model, weights of the penalties.
SAMPLE, WORDS, PENALTY, SHRINK = 12_000, 2048, 1.0, 1e-3
_SLOTS = 20


@dataclass
class Model:
    """Sorted hashes of words, their weights, and the intercept."""

    words: np.ndarray
    weights: np.ndarray
    intercept: float

    def __post_init__(self):
        self.maybe = np.zeros(1 << _SLOTS, bool)
        self.maybe[(self.words >> C.U64(64 - _SLOTS)).astype(np.int64)] = True

    def score(self, column: pa.Array) -> np.ndarray:
        h, first = distinct_words(column, self.maybe)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        own = self.words[at] == h if len(self.words) else np.zeros(len(h), bool)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        total = np.bincount(text[own], self.weights[at[own]], minlength=len(first) - 1) if len(self.words) else np.zeros(len(first) - 1)
        return 1 / (1 + np.exp(-np.clip(total + self.intercept, -30, 30)))


def distinct_words(column: pa.Array, maybe: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different words of each text (A-Z lower-cased), and the first of each text."""
    data, off = C.text_bytes(column)
    data = C.LOWER[data]
    s, e, first = C.words(data, off, C.ALNUM)
    h = C.word_hashes(data, s, e)
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    if maybe is not None:
        keep = maybe[(h >> C.U64(64 - _SLOTS)).astype(np.int64)]
        h, text = h[keep], text[keep]
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.searchsorted(text[new], np.arange(len(off)))


def sample_words(docs: DataFrame, labels: DataFrame, sample: int, learn_from) -> DataFrame:
    """doc_id, label, words (hashes) of at most sample labelled rows, chosen by a hash of doc_id."""
    rows = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("label")).filter("label_id is not null and label in (0, 1)")
    rows = rows.filter(learn_from("label_id")).dropDuplicates(["label_id"]).orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null").join(F.broadcast(rows), F.col("doc_id") == F.col("label_id")).select("doc_id", "label", "text")

    def work(batch):
        for part in C.slices(batch, "text"):
            h, first = distinct_words(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))], ["doc_id", "label", "words"])

    return C.per_batch(texts, work, "doc_id long, label int, words array<long>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, words: int = WORDS, penalty: float = PENALTY, learn_from=None) -> Model:
    """Fit on at most sample rows; words: how many words the model may weigh. learn_from(column name) is a condition on
    doc_id. With no labelled rows, or one label only, the model is an intercept."""
    rows = C.written(sample_words(docs, labels, sample, learn_from or (lambda c: F.lit(True))), "sample")
    n, pos = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    intercept = float(np.log((pos + 0.5) / (n - pos + 0.5)))
    empty = Model(np.zeros(0, C.U64), np.zeros(0), intercept)
    if not pos or pos == n:
        return empty
    counts = rows.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.sum("label").alias("p"), F.count("*").alias("c")).filter("c >= 5")
    expected = F.col("c") * F.lit(pos / n)
    chi2 = (F.col("p") - expected) ** 2 / expected / F.lit(1 - pos / n)
    chosen = counts.select("word", chi2.alias("chi2")).filter("chi2 >= 20").orderBy(F.desc("chi2"), "word").limit(words).select("word")
    kinds = [np.array([C.hash_word(w) for w in terms.split()], C.U64) for terms in IDENTITY.values()]
    identity = np.unique(np.concatenate(kinds))
    vocabulary = np.union1d(np.array([r.word for r in chosen.collect()], np.int64).view(C.U64), identity)
    known = rows.sparkSession.createDataFrame([(int(w),) for w in vocabulary.view(np.int64)], "word long")
    used = rows.select("doc_id", "label", F.explode_outer("words").alias("word")).join(F.broadcast(known.withColumn("known", F.lit(True))), "word", "left")
    data = used.groupBy("doc_id").agg(F.max("label").alias("label"), F.collect_set(F.when(F.col("known"), F.col("word"))).alias("words")).orderBy("doc_id").collect()
    y = np.array([r.label for r in data], float)
    size = np.array([len(r.words) for r in data])
    col = np.searchsorted(vocabulary, np.array([w for r in data for w in sorted(r.words)], np.int64).view(C.U64))
    row = np.repeat(np.arange(len(data)), size)
    change_row, change_col, change = counterfactuals(row, col, len(data), [np.searchsorted(vocabulary, np.unique(k)) for k in kinds])
    w, b = descend(y, row, col, change_row, change_col, change, len(vocabulary), penalty)
    keep = np.abs(w) > 1e-6
    return Model(vocabulary[keep], w[keep], b)


def counterfactuals(row, col, n: int, kinds: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Change of the features of each text when its identity terms are swapped, or a mention is put in."""
    rng = np.random.default_rng(7)
    kind_of = {int(c): k for k, cols in enumerate(kinds) for c in cols}
    rows, cols, by, seen = [], [], [], set()
    for r, c in zip(row.tolist(), col.tolist()):
        if c in kind_of:
            other = int(rng.choice(kinds[kind_of[c]]))
            rows += [r, r]
            cols += [c, other]
            by += [-1.0, 1.0]
            seen.add(r)
    for r in range(n):
        if r not in seen:
            rows.append(r)
            cols.append(int(rng.choice(kinds[int(rng.integers(len(kinds)))])))
            by.append(1.0)
    return np.array(rows), np.array(cols), np.array(by)


def objective(w, y, row, col, change_row, change_col, change, penalty: float) -> tuple[float, np.ndarray]:
    """Mean log loss + penalty times the mean squared counterfactual change + a small ridge, and the gradient. The last
    of w is the intercept; row, col: the words of the texts; change_row, change_col, change: what a swap adds to them."""
    n, width = len(y), len(w) - 1
    z = np.bincount(row, w[col], minlength=n) + w[-1]
    err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
    moved = np.bincount(change_row, change * w[change_col], minlength=n)
    value = (np.logaddexp(0, z) - y * z).mean() + penalty * (moved**2).mean() + SHRINK / 20 * (w[:-1] ** 2).sum()
    g = np.append(np.bincount(col, err[row], minlength=width) + SHRINK / 10 * w[:-1], err.sum())
    g[:-1] += 2 * penalty / n * np.bincount(change_col, change * moved[change_row], minlength=width)
    return value, g


def descend(y, row, col, change_row, change_col, change, width: int, penalty: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept of the least objective (Adam)."""
    w = np.zeros(width + 1)
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        _, g = objective(w, y, row, col, change_row, change_col, change, penalty)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a score (0 to 1) in column, in place of any column of that name. Null and empty texts get the score of a
    text without any known word."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most WORDS + the identity terms, and a table of 2^20 flags

    def work(batch):
        for part in C.slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(part.column("text")))], [*part.schema.names, column])

    schema = docs.drop(column).schema
    from pyspark.sql import types as T

    return C.per_batch(docs.drop(column), work, T.StructType([*schema.fields, T.StructField(column, T.DoubleType())]))


def held_out(column: str):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5)) == 0


def trained(spark, sf_dir: str) -> Model:
    return fit(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"), learn_from=lambda c: ~held_out(c))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    scored = score(C.table(spark, sf_dir, "documents").select("doc_id", "text"), trained(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

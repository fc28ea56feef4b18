"""PII: detected entities get keyed surrogates of the same type.

Method: surrogate generation. A surrogate is drawn by a keyed permutation of the strings of the original's format: the
same length, letter case, script and separators, vowels for vowels in names, a first name of the same gender and script
for a first name, an address in range, a valid check digit where the original has one. A permutation gives different
surrogates to different originals and the same one to each mention, on any machine, without a table of the corpus, and
never a value to itself. The check over all distinct entities still holds them against each other and, where the format
has room, against all originals; those that meet are drawn again, with the next tweak, until none does.

The key is a secret of whoever runs it: with the key the permutation can be turned back.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
import secrets
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: First names by script and gender, and words that announce a name (fixed values).
FIRST_NAMES = {
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Sandra Ashley Emily Anna Maria Julia Sophie Camille Claire Ingrid Ursula Lucia Carmen Isabel Elena",
    ("latin", "m"): "James Robert John Michael David William Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Peter Stefan Jürgen Klaus Pierre Jacques André Carlos José Miguel Diego",
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Светлана Татьяна Екатерина Юлия",
    ("cyrillic", "m"): "Иван Алексей Дмитрий Сергей Андрей Николай Михаил Павел Виктор Юрий",
    ("greek", "f"): "Ελένη Μαρία Κατερίνα Σοφία Αγγελική Βασιλική",
    ("greek", "m"): "Γιώργος Νίκος Κώστας Γιάννης Δημήτρης Παύλος",
}
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Mme Señor Señora"
_NAMES = {n: (group, i) for group, names in FIRST_NAMES.items() for i, n in enumerate(names.split())}
_CLASSES = [
    "0123456789", "bcdfghjklmnpqrstvwxz", "aeiouy", "BCDFGHJKLMNPQRSTVWXZ", "AEIOUY", "àâçéèêëîïôûùüÿñáíóúäöß", "ÀÂÇÉÈÊËÎÏÔÛÙÜÑÁÍÓÚÄÖ",
    "бвгджзклмнпрстфхцчшщ", "аеёиоуыэюя", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "АЕЁИОУЫЭЮЯ", "βγδζθκλμνξπρσςτφχψ", "αεηιουωάέήίόύώ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ", "ΑΕΗΙΟΥΩΆΈΉΊΌΎΏ",
]
_CLASS_OF = {ch: c for c in _CLASSES for ch in c}
_HEX = "0123456789abcdef"
#: Formats with fewer strings may have all of them in the corpus: their surrogates may be originals of other people.
ROOM = 1 << 20


@functools.lru_cache(1 << 12)
def _class_of(ch: str) -> str | None:
    """The characters that may stand for ch: of its listed class, or letters or digits of its kind near it in its script."""
    if ch in _CLASS_OF or not ch.isalnum():
        return _CLASS_OF.get(ch)
    kind, begin = unicodedata.category(ch), ord(ch) & ~63
    return "".join(c for c in map(chr, range(begin, begin + 64)) if unicodedata.category(c) == kind and c not in _CLASS_OF)

_KEYWORD = r"(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)\b)[\"']?\s*[=:]\s*[\"']?"
PATTERNS = [
    ("email", r"[\w.+%\-]+@[\w\-]+(?:\.[\w\-]+)+"),
    ("secret", r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|AKIA[0-9A-Z]{16}|(?:sk|pk|ghp|gho|xox[bap])[-_][0-9A-Za-z\-_]{16,})(?![0-9A-Za-z])"),
    ("iban", r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"),
    ("ssn", r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"),
    ("phone", r"(?<![\w+])\+\d{1,3}(?:[ .\-]?\(\d{1,4}\))?(?:[ .\-]?\d{2,5}){2,5}(?!\w)|(?<![\w(])\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}(?!\w)|(?<![\w.\-/])0\d(?P<gap>[ .\-])\d\d(?:(?P=gap)\d\d){3}(?![\w\-/])|(?<![\w.\-/+])555-\d{4}(?![\w\-/])"),
    ("card", r"(?<![\w])(?:\d{4}[ \-]){3}\d{4}(?!\w)|(?<!\w)\d{13,19}(?!\w)"),
]
_FIND = re.compile("|".join(f"(?P<{n}>{p})" for n, p in PATTERNS))
_SAID = re.compile(_KEYWORD + r"([0-9A-Za-z_\-/+.]{8,})")
_LETTER = r"[^\W\d_]"
_CAPITAL = "[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ]"
_WORD = rf"{_CAPITAL}{_LETTER}+(?:-{_LETTER}+)?"
_LISTED = "|".join([*_NAMES, *(n.upper() for n in _NAMES)])
_TITLE = rf"(?:{'|'.join([*TITLES.split(), *TITLES.upper().split()])})\.?"
#: A title with one or two names behind it, or a listed first name with a last name.
_NAME = re.compile(rf"(?<!\w){_TITLE}[ ]+(?P<first>{_WORD})(?:[ ]+(?P<last>{_WORD}))?(?!\w)|(?<!\w)(?P<known>{_LISTED})[ ]+(?P<after>{_WORD})(?!\w)")
#: Two capitalised words beside a name that is known already: "and Wei Chen", "Priya Patel and".
_JOINED = re.compile(rf"(?<!\w)(?P<one>{_WORD}) (?P<two>{_WORD})(?!\w)")
_AND = r"(?:and|or|und|oder|et|ou|y|o|и|или|και|&|,)"
_BEFORE, _AFTER = re.compile(rf"{_AND} $"), re.compile(rf" ?{_AND} ")
#: Bytes without which a text can hold no entity but names: digits, @, = and :.
_MARKS = np.zeros(256, bool)
_MARKS[[*b"0123456789@=:_"]] = True
#: How secrets begin that may have none of these.
_HEADS = re.compile(rb"AKIA|(?:sk|pk|ghp|gho|xox[bap])-")


def _names(text: str) -> list[tuple[int, int, str]]:
    """Names of a text: those with a title or a listed first name, pairs of capitalised words that a conjunction joins to
    one of them, and wherever else a name of these stands by itself, as written, possessive or in capitals. A word of a
    found name that is an ordinary word too is replaced at each of its places in that text."""
    found = []
    for m in _NAME.finditer(text):
        if m["known"]:
            found += [(*m.span("known"), "first_name"), (*m.span("after"), "last_name")]
        elif m["last"]:
            found += [(*m.span("first"), "first_name"), (*m.span("last"), "last_name")]
        else:
            found.append((*m.span("first"), "last_name"))
    if not found:
        return found
    begins, ends = {a for a, _, _ in found}, {z for _, z, _ in found}
    pairs = [m for m in _JOINED.finditer(text) if m.start() not in begins and m.end() not in ends]
    joined = {}
    for m in pairs:
        before = _BEFORE.search(text, max(m.start() - 6, 0), m.start())
        if before and before.start() - (text[max(before.start() - 1, 0)] == " ") in ends:
            joined[m.start()] = m
            ends.add(m.end())
    for m in reversed(pairs):
        after = _AFTER.match(text, m.end())
        if after and after.end() in begins:
            joined[m.start()] = m
        if m.start() in joined:
            begins.add(m.start())
    for m in joined.values():
        found += [(*m.span("one"), "first_name"), (*m.span("two"), "last_name")]
    kinds: dict[str, str] = {}
    for a, z, kind in sorted(found):
        kinds.setdefault(text[a:z], kind)
    for value, kind in list(kinds.items()):
        kinds.setdefault(value.upper(), kind)
    again = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(kinds, key=lambda v: (-len(v), v))))})(?!\w)")
    known = {a for a, _, _ in found}
    return found + [(*m.span(), kinds[m[0]]) for m in again.finditer(text) if m.start() not in known]


def detect(text: str, marked: bool = True, named: bool = True) -> list[tuple[int, int, str]]:
    """Entities of a text as (start, end, type), from the left, without overlaps."""
    found = []
    if marked:
        found += [(m.start(), m.end(), m.lastgroup) for m in _FIND.finditer(text)]
        found += [(m.start(1), m.end(1), "secret") for m in _SAID.finditer(text) if any(map(str.isalnum, m[1]))]
    if named:
        found += _names(text)
    out, done = [], 0
    for a, z, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if a >= done:
            out.append((a, z, kind))
            done = z
    return out


def _number(key: bytes, *parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(map(str, parts)).encode(), key=key, digest_size=32).digest(), "big")


def permuted(x: int, sizes: tuple[int, int], key: bytes, tweak: str) -> int:
    """A keyed permutation of the numbers below sizes[0] * sizes[1], which leaves none in place (but for one number alone):
    the next number in an order in which each half in turn moves by a hash of the other."""
    a, b = divmod(x, sizes[1])
    for r in reversed(range(4)):
        b = (b - _number(key, tweak, r, "b", a)) % sizes[1]
        a = (a - _number(key, tweak, r, "a", b)) % sizes[0]
    a, b = divmod((a * sizes[1] + b + 1) % (sizes[0] * sizes[1]), sizes[1])
    for r in range(4):
        a = (a + _number(key, tweak, r, "a", b)) % sizes[0]
        b = (b + _number(key, tweak, r, "b", a)) % sizes[1]
    return a * sizes[1] + b


def room(value: str) -> int:
    """How many strings have the format of value, as far as it matters."""
    out = 1
    for ch in value:
        out *= len(_class_of(ch) or "x")
        if out >= ROOM:
            break
    return out


def same_format(value: str, key: bytes, tweak: str, alphabet: str | None = None) -> str:
    """value with each letter and digit replaced in its class; a permutation of the strings of the same format."""
    classes = [alphabet if alphabet and ch in alphabet else _class_of(ch) for ch in value]
    places = [i for i, c in enumerate(classes) if c]
    if not places:
        return value
    sizes = [1, 1]
    x = 0
    for n, i in enumerate(places):
        x = x * len(classes[i]) + classes[i].index(value[i])
        sizes[n >= len(places) // 2 and len(places) > 1] *= len(classes[i])
    form = "".join("#" if c is None else chr(0x100 + _CLASSES.index(c)) if c in _CLASSES else "*" if c == alphabet else f"<{c[0]}>" for c in classes)
    y = permuted(x, (sizes[0], sizes[1]), key, f"{tweak}|{form}")
    out = list(value)
    for i in reversed(places):
        y, d = divmod(y, len(classes[i]))
        out[i] = classes[i][d]
    return "".join(out)


def _check_digit(digits: str) -> str:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


def _iban_digits(text: str) -> int:
    return int("".join(str(int(ch, 36)) for ch in text))


def surrogate(kind: str, value: str, key: bytes, tweak: int = 0) -> str:
    """The replacement of a value; tweak draws another one."""
    t = f"{kind}|{tweak}"
    if kind == "ip":
        octets = [int(o) for o in value.split(".")]
        x = permuted(int.from_bytes(bytes(octets), "big"), (1 << 16, 1 << 16), key, t)
        return ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "email":
        local, _, domain = value.rpartition("@")
        name, dot, top = domain.rpartition(".")
        return same_format(f"{local}@{name}", key, t) + dot + top
    if kind == "phone" and value.startswith("+"):
        code = re.match(r"\+\d{1,3}(?=[ .\-(])|\+\d", value)[0]
        return code + same_format(value[len(code) :], key, f"{t}|{code}")
    if kind == "phone" and re.match(r"0\d\D", value):
        return "0" + same_format(value[1:], key, t + "|0")
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        if _check_digit(digits[:-1]) == digits[-1]:
            new = same_format(digits[:-1], key, t + "|checked")
            new = iter(new + _check_digit(new))
            return "".join(next(new) if ch.isdigit() else ch for ch in value)
        new = same_format(value, key, t)
        return new
    if kind == "iban":
        plain = value.replace(" ", "")
        body = same_format(plain[4:], key, f"{t}|{plain[:2]}")
        new = iter(f"{plain[:2]}{98 - _iban_digits(body + plain[:2] + '00') % 97:02d}{body}")
        return "".join(ch if ch == " " else next(new) for ch in value)
    if kind == "secret":
        return same_format(value, key, t, _HEX if set(value) <= set(_HEX) else None)
    if kind.endswith("_name") and len(value) > 1 and value.isupper():
        return surrogate(kind, value.title(), key, tweak).upper()
    if kind == "first_name" and value in _NAMES:
        group, i = _NAMES[value]
        names = FIRST_NAMES[group].split()
        order = sorted(range(len(names)), key=lambda j: _number(key, t, group, j))
        return names[order[(order.index(i) + 1) % len(names)]]
    return same_format(value, key, t)


@functools.lru_cache(1 << 16)
def _kept(kind: str, value: str, key: bytes) -> str:
    return surrogate(kind, value, key)


def _hints() -> np.ndarray:
    """Slots of the hashes of first names and titles."""
    h = np.array([C.hash_word(w) for n in [*_NAMES, *TITLES.split()] for w in (n, n.upper())], C.U64)
    table = np.zeros(1 << 20, bool)
    table[(h >> C.U64(44)).astype(np.int64)] = True
    return table


def _found(column: pa.Array, hints: np.ndarray) -> list[tuple[str, list]]:
    """For each text that holds any entity its number, the text and its entities."""
    data, off = C.text_bytes(column)
    marks = np.concatenate([[0], np.cumsum(_MARKS[data])])
    marked = marks[off[1:]] > marks[off[:-1]]
    for m in _HEADS.finditer(data.tobytes()):
        marked[np.searchsorted(off, m.start(), side="right") - 1] = True
    data_, data = data, data.copy()  # quotes, dashes and spaces beyond ASCII end a word too
    follows = np.append(data[1:], np.uint8(0))
    for size, at in ((2, data == 0xC2), (3, ((data == 0xE2) & ((follows == 0x80) | (follows == 0x81))) | ((data == 0xE3) & (follows == 0x80)))):
        at = np.flatnonzero(at)
        for j in range(size):
            data[np.minimum(at + j, len(data) - 1)] = 0x20
    s, e, first = C.words(data, off, C.ALNUM)
    upper = ((data[s] >= 0x41) & (data[s] <= 0x5A)) | (data[s] >= 0xC3)
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))[upper]
    h = C.word_hashes(data, s[upper], e[upper])
    named = np.zeros(len(off) - 1, bool)
    named[text[hints[(h >> C.U64(44)).astype(np.int64)]]] = True
    out = []
    for i in np.flatnonzero(marked | named).tolist():
        t = data_[off[i] : off[i + 1]].tobytes().decode()
        if got := detect(t, bool(marked[i]), bool(named[i])):
            out.append((i, t, got))
    return out


ENTITIES = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())]))


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, type, value, mentions: the entities of each text."""
    hints = _hints()

    def work(batch):
        for part in C.slices(batch, "text"):
            ids, out = part.column("doc_id"), []
            for i, t, got in _found(part.column("text"), hints):
                counts: dict = {}
                for a, z, kind in got:
                    counts[kind, t[a:z]] = counts.get((kind, t[a:z]), 0) + 1
                out += [(ids[i].as_py(), kind, v, n) for (kind, v), n in counts.items()]
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32())], ["doc_id", "type", "value", "mentions"])

    return C.per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, type string, value string, mentions int")


def redrawn(found: DataFrame, key: bytes, rounds: int = 200) -> DataFrame | None:
    """type, value, surrogate of those whose first surrogate meets another's or an original; None if there are none. Where
    a format has too few strings only surrogates are held against each other. It goes on until none meets; if that isn't
    reached in so many rounds, as no corpus with room in its formats should need, it raises an error."""
    originals = C.written(found.select("type", "value").distinct(), "originals")

    def drawn(df, tweak):
        def work(batch):
            kinds, values = batch.column("type").to_pylist(), batch.column("value").to_pylist()
            new = [surrogate(k, v, key, tweak) for k, v in zip(kinds, values)]
            wide = [k != "first_name" and room(v) >= ROOM for k, v in zip(kinds, values)]
            yield pa.RecordBatch.from_arrays([batch.column("type"), batch.column("value"), pa.array(new, pa.string()), pa.array(wide, pa.bool_())], ["type", "value", "surrogate", "wide"])

        return C.per_batch(df.select("type", "value"), work, "type string, value string, surrogate string, wide boolean")

    now, moved = C.written(drawn(originals, 0), "surrogates"), None
    for tweak in itertools.count(1):
        shared = now.groupBy("type", "surrogate").agg(F.count("*").alias("c"), F.min("value").alias("keeps")).filter("c > 1").select("type", "surrogate", "keeps")
        twice = now.join(shared, ["type", "surrogate"]).filter(F.col("value") != F.col("keeps")).select("type", "value")
        real = originals.select(F.col("type"), F.col("value").alias("surrogate"))
        meets = now.filter("wide").join(real, ["type", "surrogate"], "left_semi").select("type", "value")
        bad = C.written(twice.unionByName(meets).distinct(), "collisions")
        if bad.isEmpty():
            return moved
        if tweak > rounds:
            raise RuntimeError(f"surrogates still meet after {rounds} rounds")
        again = drawn(bad, tweak)
        now = C.written(now.join(bad, ["type", "value"], "left_anti").unionByName(again), "surrogates")
        fresh = now.join(bad, ["type", "value"], "left_semi").select("type", "value", "surrogate")
        moved = C.written(fresh if moved is None else moved.join(bad, ["type", "value"], "left_anti").unionByName(fresh), "redrawn")


def session_key(spark) -> str:
    """The key of spark.nightflux.pii.key; where that is unset a new one, so that surrogates hold for one call only."""
    return spark.conf.get("spark.nightflux.pii.key", None) or secrets.token_hex(32)


def replace(docs: DataFrame, key: str, column: str = "entities") -> DataFrame:
    """docs with the entities of text replaced, and listed in column (type, start and length in the new text).

    No original of a name found in a text stays in that text: bare and possessive mentions get the surrogate of the full
    one, those in capitals the same surrogate in capitals (unless a collision had one of the forms drawn again). Other
    forms of a name, as initials or nicknames, aren't tied to it.

    All columns stay, but one of that name. Null texts stay null and empty ones empty. Rows without
    doc_id and rows that are repeated are handled like all others: a surrogate depends on key, type and value alone.
    """
    secret, hints = hashlib.sha256(key.encode()).digest(), _hints()
    docs = docs.drop(column)
    found = C.written(entities(docs), "entities")
    moved = redrawn(found, secret)
    source = docs
    if moved is not None:
        # rows without doc_id have no join key: their redrawn values, all together, are dealt by text
        lists = found.filter("doc_id is not null").join(moved, ["type", "value"]).groupBy("doc_id").agg(F.collect_set(F.struct("type", "value", "surrogate")).alias("__moved")).withColumnRenamed("doc_id", "__moved_id")
        source = docs.join(C.written(lists, "moved"), F.col("doc_id").cast("long") == F.col("__moved_id"), "left").drop("__moved_id")
        nameless = docs.filter("doc_id is null")
        if not nameless.isEmpty():
            keyed = nameless.select("text", F.md5(F.col("text").cast("binary")).alias("__text")).filter("__text is not null").dropDuplicates(["__text"])
            own = C.written(entities(keyed.select(F.xxhash64("__text").alias("doc_id"), "text")), "nameless")
            lists = own.join(moved, ["type", "value"]).groupBy("doc_id").agg(F.collect_set(F.struct("type", "value", "surrogate")).alias("__moved")).withColumnRenamed("doc_id", "__moved_id")
            nameless = nameless.join(C.written(lists, "moved"), F.xxhash64(F.md5(F.col("text").cast("binary"))) == F.col("__moved_id"), "left").drop("__moved_id")
            source = source.filter("doc_id is not null").unionByName(nameless)
    names = docs.columns
    at = names.index("text")
    kinds = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))

    def work(batch):
        for part in C.slices(batch, "text"):
            texts, found_ = part.column("text").to_pylist(), [[] for _ in range(part.num_rows)]
            own = part.column("__moved").to_pylist() if "__moved" in part.schema.names else [None] * part.num_rows
            for i, t, got in _found(part.column("text"), hints):
                other = {(m["type"], m["value"]): m["surrogate"] for m in own[i] or ()}
                new, done, size = [], 0, 0
                for a, z, kind in got:
                    s = other.get((kind, t[a:z])) or _kept(kind, t[a:z], secret)
                    new += [t[done:a], s]
                    size += a - done
                    found_[i].append({"type": kind, "start": size, "length": len(s)})
                    size += len(s)
                    done = z
                texts[i] = "".join([*new, t[done:]])
            cols = [part.column(n) for n in names]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(found_, kinds)], [*names, column])

    return C.per_batch(source, work, T.StructType([*docs.schema.fields, T.StructField(column, ENTITIES)]))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """All documents with their entities replaced: doc_id, n_entities, types, text, text_sha256."""
    done = replace(C.table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("entities", lambda x: x.type))), ",")
    return done.select("doc_id", F.size("entities").cast("long").alias("n_entities"), kinds.alias("types"), "text", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))

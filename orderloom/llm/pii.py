"""Personal data in texts: marked by the tagger, trimmed, replaced by typed placeholders.

Texts are read whole, line by line; long lines in overlapping windows. A line met again in a task is not decoded again.
A line that lacks all of what the five types are made of (see Gate) is not decoded either; the tests measure what that
loses on lines of no generator (nothing). The spans of all windows of a line are reconciled. The tagger alone decides on
type and bounds; what follows trims quotes and blanks, and leaves out what the types' definitions leave out.
"""

import hashlib
import inspect
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from orderloom.llm import pii_examples, tagger as tagger_module
from orderloom.llm.pii_examples import PARTICLES, ROLE, TYPES, Maker
from orderloom.llm.tagger import PAD, Tagger, char_classes, spans
from orderloom.llm.tokens import TOKENIZER, encoding
from orderloom.sources.tables import shared_dir

HIDDEN = 24
SHARDS = 4
ROUNDS = 14
STEPS = 170  # of each shard and round
BATCH = 64
POOL = 2_000  # labelled windows of each shard and round
LENGTH = 120  # of training windows
WINDOW = 224  # of decoded windows
OVERLAP = 80
# Where marks begin, a type's odds count for so much more (natural logarithm) than the tagger's own: finding counts for more
# than a false mark where the type's bounds are sharp.
FAVOUR = {"email": 2.0, "phone": 0.0, "national_id": 0.5, "street": 1.0, "name": 1.5}
ROWS = 512  # windows decoded at once
CHUNK = 1 << 22  # characters of texts worked on at once
REMEMBERED = 1 << 25  # characters of lines whose spans a task remembers

_WORD = re.compile(r"[^\W\d_]+")
_WORD_OR_NUMBER = re.compile(r"[^\W\d_]+|\d+")
_LINE_END = re.compile("\r\n|[\n\r]")


def gazetteer(parts: list[tuple[str, str]]) -> dict[str, int]:
    out: dict[str, int] = {}
    for p, kind in parts:
        if p and kind in ("given", "family"):
            out[p.casefold()] = out.get(p.casefold(), 0) | (1 if kind == "given" else 2)
    return out


@lru_cache(maxsize=2)
def ordinary_words(path: str = TOKENIZER) -> frozenset[str]:
    """Words that a public vocabulary has in small letters: what most names are not."""
    words = (w.decode("utf-8", "ignore") for w in encoding(path).token_byte_values() if w[:1] == b" ")
    return frozenset(w[1:] for w in words if len(w) > 2 and w[1:].isalpha() and w.islower())


class Words:
    """What words are known as: 1 given name, 2 family name, 3 both; and 4 more where the word is an ordinary one; of
    numbers, 7 and how many digits they have (at most 8)."""

    def __init__(self, parts: dict[str, int], ordinary: frozenset[str]):
        self.parts, self.ordinary = parts, ordinary
        self.known: dict[str, int] = {}

    def flags(self, text: str, n: int) -> np.ndarray:
        """Per character, the number of its word."""
        out = np.zeros(n, np.uint8)
        for m in _WORD_OR_NUMBER.finditer(text):
            a, b = m.span()
            low = m.group()
            k = self.known.get(low)
            if k is None:
                k = self._number_of(low)
                if len(self.known) < 1 << 18:
                    self.known[low] = k
            if k:
                out[a:b] = k
        return out

    def _number_of(self, word: str) -> int:
        if word[0].isdecimal():
            return 7 + min(len(word), 8)
        low = word.casefold()
        return self.parts.get(low, 0) + 4 * (low in self.ordinary)


class Gate:
    """Can a line hold any of the types at all?

    It needs an @ or an at in brackets, or between dots written out; or six digits with little between, or digits before a
    letter as in mixed numbers; or a number not far from a capitalised word or a word for a street; or two capitalised words side by side, or with
    particles between; or a known part of names; or letters of a script without capitals.
    """

    _CAPITAL = "[A-ZÀ-ԯḀ-῿]"
    _AT = re.compile(r"[\[({<_] ?[aA][tT] ?[\])}>_]")
    _NUMBER = re.compile(
        rf"\d(?:(?:[^\w\n]{{0,3}}\d){{5}}|\d[A-Za-z]\d\d[A-Za-z]|\d{{3}}[A-Za-z]\b|[\w/-]{{0,6}},? (?:[^\W\d_][\w.'’-]*,? ){{0,4}}(?:{_CAPITAL}|(?:calle|via|rua|rue|street|road|avenue|lane)\b))"
    )
    _CAPITALISED = re.compile(
        rf"{_CAPITAL}[\w.'’-]*(?:[ ,.]{{1,2}}(?:[a-z]{{1,4}}[ '’]){{0,3}}{_CAPITAL}|,? (?:[^\W\d_][\w.'’-]*,? ){{0,3}}(?:No: ?)?\d)"
    )
    _STREET = re.compile(r"\b(?:calle|via|rua|rue|ulica|street)\b.{2,30}\d")
    _NO_CASE = re.compile("[԰-᷿⺀-퟿豈-ￜ]")
    _SIGNS = str.maketrans({c: " " for c in string.punctuation if c not in "'-"})

    def __init__(self, parts: dict[str, int]):
        self.parts = parts

    def __call__(self, line: str) -> bool:
        if "@" in line or self._CAPITALISED.search(line) or self._NUMBER.search(line) or self._AT.search(line):
            return True
        low = line.casefold()
        if " dot " in low or not self.parts.keys().isdisjoint(low.translate(self._SIGNS).split()):
            return True
        return bool(self._STREET.search(low) or (not line.isascii() and self._NO_CASE.search(line)))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def encode_example(text: str, found, words: Words, length: int):
    codes = code_points(text)
    chars = np.zeros(length, np.uint8)
    flags = np.zeros(length, np.uint8)
    gold = np.zeros(length, np.int64)
    n = len(codes)
    chars[:n] = char_classes(codes)
    flags[:n] = words.flags(text, n)
    for s, e, kind in found:
        k = TYPES.index(kind)
        gold[s] = 2 * k + 1
        gold[s + 1 : e] = 2 * k + 2
    return chars, flags, gold


@lru_cache(maxsize=2)
def _maker(parts: tuple[tuple[str, str], ...]) -> Maker:
    return Maker(0, list(parts))


def _pool(parts: tuple[tuple[str, str], ...], path: str, seed: int, n: int):
    """So many labelled windows as arrays, in order of their length."""
    words = Words(gazetteer(list(parts)), ordinary_words(path))
    maker = _maker(parts)
    maker.r.seed(seed)
    pool = [encode_example(*maker.window(LENGTH), words, LENGTH) for _ in range(n)]
    pool.sort(key=lambda x: int((x[0] != PAD).sum()))
    return tuple(np.stack(x) for x in zip(*pool))


def _train_some(tagger: Tagger, state: dict, pool, seed: int, first: int, steps: int) -> None:
    """So many steps of a tagger on a pool, whose neighbours make batches, as they are of about the same length."""
    # The C library keeps up to twice the largest block freed so far; else it gives each step's arrays back to the system,
    # and mapping their pages anew takes a third of the time.
    np.empty(31 << 20, np.uint8)
    chars, flags, gold = pool
    rng = np.random.default_rng(seed)
    near = min(20 * BATCH, len(chars))

    def draw(_: int):
        at = rng.integers(0, len(chars) - near + 1) + rng.choice(near, BATCH, replace=False)
        width = max(1, int((chars[at] != PAD).sum(1).max()))
        hide = rng.random((BATCH, 1)) < 0.3  # names that no list knows
        return chars[at, :width], np.where(hide & (flags[at, :width] < 8), flags[at, :width] & 4, flags[at, :width]), gold[at, :width]

    tagger.train(draw, steps, state, first, ROUNDS * STEPS)


def trained(spark, parts: tuple[tuple[str, str], ...], path: str = TOKENIZER) -> Tagger:
    """A tagger trained on ROUNDS x SHARDS x POOL invented labelled lines; the same for the same arguments.

    Each round trains SHARDS copies in as many tasks, each on lines of its own, and goes on from their mean. As many more
    tasks beside them make the next round's lines.
    """
    tagger = Tagger.fresh(TYPES, HIDDEN, 7)
    state = tagger.fresh_state()
    pools: dict[int, tuple[np.ndarray, ...]] = {}
    kinds = ("chars", "flags", "gold")

    def work(k: int, n: int):
        def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for task in batch["id"].tolist():
                    shard = task % SHARDS
                    seed = 1000 * (k + 1) + shard
                    if task >= SHARDS:
                        rows = dict(zip(kinds, (x.astype(np.uint8) for x in _pool(parts, path, seed + 1000, POOL))))
                    else:
                        own = Tagger({x: w.copy() for x, w in tagger.weights.items()}, TYPES)
                        moments = {x: w.copy() for x, w in state.items()}
                        chars, flags, gold = pools[shard]
                        _train_some(own, moments, (chars, flags, gold.astype(np.int64)), seed, k * n, n)
                        rows = {x: w.astype(np.float32) for x, w in {**own.weights, **{f"{x} state": w for x, w in moments.items()}}.items()}
                    yield pd.DataFrame({"task": task, "name": list(rows), "bytes": [w.tobytes() for w in rows.values()]})

        return one

    for k in range(-1, ROUNDS):
        first, last = SHARDS * (k < 0), SHARDS * (1 + (k + 1 < ROUNDS))
        rows = spark.range(first, last, 1, last - first).mapInPandas(work(k, STEPS), "task long, name string, bytes binary").collect()
        of = {(r["task"], r["name"]): r["bytes"] for r in rows}
        if k >= 0:
            mean = lambda x: sum(np.frombuffer(of[i, x], np.float32) for i in range(SHARDS)) / np.float32(SHARDS)
            tagger.weights = {x: mean(x).reshape(w.shape) for x, w in tagger.weights.items()}
            state = {x: mean(f"{x} state").reshape(w.shape) for x, w in state.items()}
        if last > SHARDS:
            pools = {i: tuple(np.frombuffer(of[SHARDS + i, x], np.uint8).reshape(-1, LENGTH) for x in kinds) for i in range(SHARDS)}
    return tagger


def windows_of(line: str) -> list[tuple[int, str]]:
    """(first character, text) of the overlapping windows of a line; one where it is short."""
    if len(line) <= WINDOW:
        return [(0, line)]
    return [(a, line[a : a + WINDOW]) for a in range(0, len(line) - OVERLAP, WINDOW - OVERLAP)]


class Finder:
    """Finds personal data in texts; lives in a task and remembers the lines it has met."""

    def __init__(self, tagger: Tagger, parts: dict[str, int], path: str = TOKENIZER):
        tagger = Tagger({k: w.copy() for k, w in tagger.weights.items()}, TYPES)
        tagger.weights["step"][0, 1::2] += np.array([FAVOUR[k] for k in TYPES], np.float32)
        self.tagger, self.gate, self.words = tagger, Gate(parts), Words(parts, ordinary_words(path))
        self.known: dict[str, list[tuple[int, int, int]]] = {}
        self.size = 0

    def __call__(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Spans (start, end, type) of each text, in order and disjoint."""
        out: list[list[tuple[int, int, str]]] = []
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) < CHUNK):
                size += len(texts[j])
                j += 1
            out += self._chunk(texts[i:j])
            i = j
        return out

    def _chunk(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        lines = [_LINE_END.split(t) for t in texts]
        if self.size > REMEMBERED:
            self.known, self.size = {}, 0
        new = {x for ls in lines for x in ls}.difference(self.known)
        self.size += sum(map(len, new))
        self.known.update(dict.fromkeys(new, ()))
        self._decode([x for x in new if self.gate(x)])
        out = []
        for text, ls in zip(texts, lines):
            found: list[tuple[int, int, str]] = []
            at = 0
            for x in ls:
                found += [(at + s, at + e, TYPES[k]) for s, e, k in self.known[x]]
                at += len(x)
                at += 2 if text.startswith("\r\n", at) else 1
            out.append(found)
        return out

    def _decode(self, lines: list[str]) -> None:
        """Remembers the spans of these lines."""
        units = [(k, a, w) for k, x in enumerate(lines) for a, w in windows_of(x)]
        units.sort(key=lambda u: len(u[2]))  # windows of about the same length are decoded together
        found: list[list[tuple[int, int, int, int, int]]] = [[] for _ in lines]
        for i in range(0, len(units), ROWS):
            part = units[i : i + ROWS]
            joined = "\n".join(w for _, _, w in part)
            codes = code_points(joined)
            size = np.array([len(w) for _, _, w in part])
            first = np.cumsum(size + 1) - size - 1
            at = first[:, None] + np.arange(max(1, size.max()))
            real = at < (first + size)[:, None]
            at = np.minimum(at, len(codes) - 1)
            flags = self.words.flags(joined, len(codes))
            labels = self.tagger.decode(np.where(real, char_classes(codes)[at], PAD), np.where(real, flags[at], 0))
            for r, s, e, kind in spans(labels):
                k, a, w = part[r]
                # how far the span keeps from an edge at which the window was cut
                left = s if a else OVERLAP
                right = len(w) - e if a + len(w) < len(lines[k]) else OVERLAP
                found[k].append((min(left, right, OVERLAP // 2), e - s, a + s, a + e, kind))
        for x, f in zip(lines, found):
            if f:
                self.known[x] = settled(x, reconcile(f))


def reconcile(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int]]:
    """Of overlapping spans of different windows, the one with more room around it, then the longer one."""
    kept: list[tuple[int, int, int]] = []
    taken: dict[int, list[tuple[int, int]]] = {}
    for _, _, s, e, kind in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[4])):
        cells = range(s // 256, e // 256 + 1)
        if any(s < y and x < e for c in cells for x, y in taken.get(c, ())):
            continue
        kept.append((s, e, kind))
        for c in cells:
            taken.setdefault(c, []).append((s, e))
    return sorted(kept)


def settled(line: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans, trimmed and disjoint, without those that the types' definitions leave out."""
    out: list[tuple[int, int, int]] = []
    for s, e, k in found:
        s, e = trim(line, s, e, TYPES[k])
        if s < e and (not out or s >= out[-1][1]) and counts(line, s, e, TYPES[k]):
            out.append((s, e, k))
    return out


_ADDRESS = re.compile(
    r"[\w.+-]+(?: ?@ ?|[ ]?[\[({<_]at[\])}>_][ ]?| at )[^\W_](?:[\w-]*[^\W_])?(?:(?:\.|[ ]?[\[({<_]dot[\])}>_][ ]?| dot )[^\W_](?:[a-z0-9-]*[a-z0-9])?)+", re.I
)


def trim(line: str, s: int, e: int, kind: str) -> tuple[int, int]:
    """The mark made up to whole words, without blanks, quotes, brackets and marks around it."""
    if kind == "email":  # words after the address, or before it
        near = [m.span() for m in _ADDRESS.finditer(line, max(0, s - 40), e + 40) if m.start() < e and s < m.end()]
        if near:
            s, e = max(near, key=lambda x: min(e, x[1]) - max(s, x[0]))
    while 0 < s and line[s - 1].isalnum() and line[s].isalnum():
        s -= 1
    while e < len(line) and line[e - 1].isalnum() and line[e].isalnum():
        e += 1
    while s < e and not (line[s].isalnum() or (kind == "phone" and line[s] in "+(") or (kind == "email" and line[s] == "_")):
        s += 1
    while s < e and not line[e - 1].isalnum():
        word = line[s : e - 1].split(" ")[-1]
        if line[e - 1] == "." and (kind == "street" and word.isalpha() and len(word) <= 4 or kind == "name" and len(word) == 1):
            break
        e -= 1
    if kind == "name":  # small words before or after it
        while len(rest := re.split(r"[ ,]+", line[s:e], maxsplit=1)) > 1 and _WORD.fullmatch(rest[0]) and rest[0].islower() and rest[1][:1].isupper() and rest[0] not in PARTICLES:
            s = e - len(rest[1])
    if kind in ("name", "street"):
        while len(rest := line[s:e].rsplit(" ", 1)) > 1 and _WORD.fullmatch(rest[1]) and rest[1].islower() and any(c.isupper() for c in rest[0]):
            e = s + len(rest[0].rstrip(" ,.;:" if kind == "name" else " ,;:"))
    if kind == "phone" and s and line[s - 1] in "+(" and line[s] not in "+(":
        s -= 1
    if kind == "street" and e < len(line) and line[e] == "." and re.search(r"\b(?:St|Rd|Ln|Ave|Ct|Dr|Blvd|Sq|Pl)$", line[s:e]):
        e += 1
    return s, e


_ROLES = frozenset(ROLE)
# Fixed formats of other things: network addresses, days, unique ids, accounts of people with a host.
_OTHER_FORMAT = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}|(?:19|20)\d\d([-./])\d\d\1\d\d|[0-9a-f]{8}(?:-[0-9a-f]{2,12})+|.*[@:].*", re.I)


def counts(line: str, s: int, e: int, kind: str) -> bool:
    """What the definitions ask of a type: a person's address, not one of a function or machine or a URL's credentials; a
    number's digits; a house number; two parts of a name."""
    v = line[s:e]
    digits = sum(c.isdigit() for c in v)
    if kind == "email":
        local = re.split(r"\s*@|[\s\[({<_]+at[\s\])}>_]", v, maxsplit=1, flags=re.I)[0]
        if len(local) == len(v) or not local or _ROLES.intersection(re.split(r"[._\d+-]+", local.lower())):
            return False
        return not re.search(r"://[^\s@/]*$", line[:s])
    if kind == "phone":
        return 7 <= digits <= 15 and not _OTHER_FORMAT.fullmatch(v)
    if kind == "national_id":
        return digits >= 4 and not _OTHER_FORMAT.fullmatch(v)
    if kind == "street":
        return 0 < digits and any(c.isalpha() for c in v) and not re.match(r"\d+[.:;]", v)
    return not digits and (len(_WORD.findall(v)) > 1 or (not v.isascii() and len(v) > 1 and bool(Gate._NO_CASE.match(v))))


@lru_cache(maxsize=4)
def _made_from(parts: tuple[tuple[str, str], ...]) -> str:
    """A hash of all that a tagger is made from."""
    of = [inspect.getsource(pii_examples), inspect.getsource(tagger_module), repr((SHARDS, ROUNDS, STEPS, HIDDEN, BATCH, POOL, LENGTH, parts))]
    return hashlib.sha256("".join(of).encode()).hexdigest()[:24]


_TRAINED: dict[str, Tagger] = {}


def saved(spark, parts: tuple[tuple[str, str], ...]) -> Tagger:
    """The trained tagger: of this process, or from the shared folder, where it is kept for later ones; else trained now."""
    key = _made_from(parts)
    if key in _TRAINED:
        return _TRAINED[key]
    path = f"{shared_dir(spark)}/tagger-{key}"
    tagger = Tagger.fresh(TYPES, HIDDEN, 0)
    try:
        rows = {r["name"]: np.frombuffer(r["bytes"], np.float32) for r in spark.read.schema("name string, bytes binary").parquet(path).collect()}
    except AnalysisException:
        rows = {}
    if set(rows) == set(tagger.weights) and all(rows[k].size == w.size for k, w in tagger.weights.items()):
        tagger.weights = {k: rows[k].reshape(w.shape) for k, w in tagger.weights.items()}
    else:
        tagger = trained(spark, parts)
        rows = [(k, bytearray(w.tobytes())) for k, w in tagger.weights.items()]
        spark.createDataFrame(rows, "name string, bytes binary").coalesce(1).write.mode("overwrite").parquet(path)
    _TRAINED[key] = tagger
    return tagger


def _finder(name_parts: DataFrame) -> tuple[Tagger, dict[str, int]]:
    """The tagger for a list of name parts, which is a small table and doesn't grow."""
    rows = name_parts.select("name_part", "part_kind").dropna().distinct().collect()
    parts = tuple(sorted((r["name_part"], r["part_kind"]) for r in rows))
    return saved(name_parts.sparkSession, parts), gazetteer(list(parts))


def find_pii(documents: DataFrame, name_parts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per place: key, start, end (code points), pii_type, pii_value as it stands in the text.

    A NULL or empty text has none; very long texts are searched whole; repeated rows and NULL keys are texts of their
    own. What goes over a line's end is not found as one value. Other columns are dropped. An empty table gives no row.
    The key must not be named start, end, pii_type or pii_value.
    """
    tagger, parts = _finder(name_parts)
    kind_of_key = documents.schema[key].dataType
    rows = documents.select(F.col(key).cast("string").alias(key), text)  # pandas would make doubles of numbers beside NULLs
    schema = StructType(
        [
            StructField(key, StringType()),
            StructField("start", IntegerType()),
            StructField("end", IntegerType()),
            StructField("pii_type", StringType()),
            StructField("pii_value", StringType()),
        ]
    )

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(tagger, parts)
        for batch in batches:
            texts = [t or "" for t in batch[text]]
            got = finder(texts)
            many = [len(x) for x in got]
            flat = [(s, e, kind, t[s:e]) for t, x in zip(texts, got) for s, e, kind in x]
            columns = list(zip(*flat)) if flat else [(), (), (), ()]
            kinds = {"start": "int32", "end": "int32", "pii_type": object, "pii_value": object}
            out = {c: pd.Series(list(v), dtype=d) for (c, d), v in zip(kinds.items(), columns)}
            keys = batch[key].to_numpy(object)[np.repeat(np.arange(len(batch)), many)]
            yield pd.DataFrame({key: pd.Series(keys, dtype=object), **out})

    return rows.mapInPandas(find, schema).withColumn(key, F.col(key).cast(kind_of_key))


def redact_pii(documents: DataFrame, name_parts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, text with [EMAIL], [PHONE], [NATIONAL_ID], [STREET] and [NAME] in place of what was found,
    n_replaced. All else of the text is unchanged; a NULL text stays NULL. Otherwise as find_pii()."""
    tagger, parts = _finder(name_parts)
    kind_of_key = documents.schema[key].dataType
    rows = documents.select(F.col(key).cast("string").alias(key), text)
    schema = StructType([StructField(key, StringType()), StructField(text, StringType()), StructField("n_replaced", LongType())])

    def replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(tagger, parts)
        for batch in batches:
            texts = [t or "" for t in batch[text]]
            got = finder(texts)
            new = [redacted(t, x) if x else old for t, x, old in zip(texts, got, batch[text])]
            n = pd.Series([len(x) for x in got], dtype="int64")
            yield pd.DataFrame({key: batch[key].astype(object), text: pd.Series(new, dtype=object), "n_replaced": n})

    return rows.mapInPandas(replace, schema).withColumn(key, F.col(key).cast(kind_of_key))


def redacted(text: str, found: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, kind in found:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join(out) + text[at:]

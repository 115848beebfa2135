"""Toxicity scores of texts whose disguises a noisy-channel decoder has undone.

A writer is taken to send clean letters through a channel that swaps letters for look-alike
digits and signs, repeats them, or sets them apart. For a disguised word the possible letters
form a lattice; Viterbi decoding under a character language model finds the likeliest word. A
classifier on the words of the restored text then scores it.

The language model counts letter trigrams of all documents. The classifier is fitted on a bounded
sample of labelled rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, pick, small, stage, text_udf

# Letters that digits and signs stand for.
CHANNEL = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e",
}
_SIGNS = re.escape("".join(CHANNEL))
_CHAR = rf"[A-Za-z{_SIGNS}]"
# A word with letters and signs within, a word with a letter three times, letters set apart.
_MIXED = re.compile(rf"(?<![^\W\d_])(?<![{_SIGNS}])(?=[{_SIGNS}]*[A-Za-z])(?=[A-Za-z]*[{_SIGNS}]+[A-Za-z]|[A-Za-z]+[{_SIGNS}]){_CHAR}{{3,}}+(?![^\W\d_])")
_REPEATED = re.compile(rf"(?<![^\W_])(?=[A-Za-z{_SIGNS}]*([A-Za-z])\1\1)[A-Za-z{_SIGNS}]{{3,}}(?![^\W_])")
_APART = re.compile(rf"(?<![^\W\d_])(?<![{_SIGNS.replace(re.escape('('), '').replace('<', '')}]){_CHAR}( +|\.+|\*+|_+|-+){_CHAR}(?:\1{_CHAR})+(?![^\W\d_])(?![{_SIGNS.replace('!', '')}])")
_OPENER = {")": "(", ">": "<"}

LETTERS = 27
"""Boundary and a to z."""
_CLASS = np.zeros(256, np.uint8)
_CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = 1
_CLASS[[ord(c) for c in CHANNEL if ord(c) < 128]] = 2
_WIDE = [c for c in CHANNEL if ord(c) > 127]
_BLANK = np.isin(np.arange(256), [ord(c) for c in " .*_-"])
_CODE = np.zeros(256, np.int32)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_WORDS = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x > 127 else 32 for x in range(256))


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 20_000
    """Labelled rows that the fit may read, half of them of either label."""
    prefixes: tuple[int, ...] = (4, 5, 6)
    z: float = 4.5
    """Standard errors by which a feature's log odds must differ from zero to count."""
    swap: float = 3.0
    """Cost, in nats, of a sign for a letter; a repeated letter and a gap cost a third."""


# The character language model.


def trigram_counts(docs: DataFrame) -> DataFrame:
    """``code, n`` of the letter trigrams in all of ``docs(text)``; at most 27 cubed rows."""

    def run(batches):
        total = np.zeros(LETTERS**3, np.int64)
        for batch in small(batches):
            data = np.frombuffer("\n".join(x or "" for x in batch.column("text").to_pylist()).encode(errors="surrogatepass"), np.uint8)
            code = _CODE[np.concatenate((data, np.full(2, 32, np.uint8)))]
            total += np.bincount(code[:-2] * LETTERS**2 + code[1:-1] * LETTERS + code[2:], minlength=LETTERS**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["code", "n"])

    return docs.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probability of a letter behind two others, smoothed by the bigram's."""
    counts = np.zeros(LETTERS**3)
    for row in trigram_counts(docs.select("text")).collect():
        counts[row.code] = row.n
    three = counts.reshape(LETTERS, LETTERS, LETTERS)
    two = three.sum(axis=0) + 0.5
    two /= two.sum(axis=1, keepdims=True)
    mixed = (three + 5 * two[None]) / (three.sum(axis=2, keepdims=True) + 5)
    return np.log(mixed)


# The decoder.


def _options(char: str, count: int, swap: float) -> Iterator[tuple[str, float]]:
    """What a run of one character may stand for, with the cost."""
    small_cost = swap / 3
    if char.isalpha() and count <= 2:
        yield char * count, 0.0
        return
    for letter, cost in [(char, 0.0)] if char.isalpha() else [(x, swap * min(count, 2)) for x in CHANNEL[char]]:
        yield letter, cost + (small_cost if count > 1 else 0)
        if count > 1:
            yield letter * 2, cost + (small_cost if count > 2 else 0)


def decode(word: str, model: np.ndarray, swap: float) -> str:
    """The likeliest letters behind a disguised word of letters and signs.

    Signs at the end also may stand for themselves, and then are dropped, as in "what!!".
    """
    word = word.lower()
    runs = [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", word, re.S)]
    last = max((i for i, (c, _) in enumerate(runs) if c.isalpha()), default=-1)
    # Of each state the score and the letters so far, as (before, letters) back to the last single state.
    done: list[str] = []
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for i, (char, count) in enumerate(runs):
        step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        options = list(_options(char, count, swap))
        if i > last:
            options.append(("", swap / 3))
        for (a, b), (score, path) in best.items():
            for letters, cost in options:
                x, y, value = a, b, score - cost
                for c in letters:
                    z = ord(c) - 96
                    value += model[x, y, z]
                    x, y = y, z
                if (x, y) not in step or value > step[x, y][0]:
                    step[x, y] = (value, (path, letters))
        best = step
        if len(best) == 1:
            ((state, (score, path)),) = best.items()
            done.append(_spelled(path))
            best = {state: (score, None)}
    return "".join(done) + max((value + model[a, b, 0], _spelled(path)) for (a, b), (value, path) in best.items())[1]


def _spelled(path: tuple | None) -> str:
    parts = []
    while path:
        path, letters = path
        parts.append(letters)
    return "".join(reversed(parts))


def likelihood(word: str, model: np.ndarray) -> float:
    """Log probability of a word of letters."""
    codes = [0, 0, *(ord(c) - 96 for c in word), 0]
    return float(sum(model[a, b, c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False)))


def _suspicious(text: str) -> tuple[bool, bool, bool]:
    """Whether the text may have mixed words, letters three times, or letters set apart."""
    data = np.frombuffer(text.encode(errors="surrogatepass"), np.uint8)
    if len(data) < 3:
        return False, False, False
    kind = _CLASS[data]
    wide = any(c in text for c in _WIDE)
    mixed = wide or bool(((kind[:-1] == 1) & (kind[1:] == 2)).any() or ((kind[:-1] == 2) & (kind[1:] == 1)).any())
    low = data | 32
    repeated = bool(((low[:-2] == low[1:-1]) & (low[1:-1] == low[2:]) & (kind[2:] == 1)).any())
    gap = _BLANK[data]
    once = np.concatenate(([True], ~(gap[1:] & (data[1:] == data[:-1]))))
    if not once.all():
        data, kind, gap = data[once], kind[once], gap[once]
    apart = wide or len(data) >= 5 and bool((gap[1:-3] & gap[3:-1] & (kind[:-4] > 0) & (kind[2:-2] > 0) & (kind[4:] > 0)).any())
    return mixed, repeated, apart


def restore(text: str, model: np.ndarray, swap: float, known: dict[str, str] | None = None) -> str:
    """The text with every disguised word as its likeliest letters."""
    known = {} if known is None else known

    def letters_of(word: str) -> str:
        if len(word) > 60:
            return decode(word, model, swap)
        if word not in known:
            if len(known) > 50_000:
                known.clear()
            known[word] = decode(word, model, swap)
        return known[word]

    def clear(m: re.Match) -> str:
        word, opener = m[0], _OPENER.get(m.string[m.end() : m.end() + 1])
        if opener and opener in word:  # a bracket, no letter
            return opener.join(letters_of(x) if m.re.fullmatch(x) else x for x in word.rsplit(opener, 1))
        return letters_of(word)

    def join(m: re.Match) -> str:
        letters = m[0].replace(m[1], "")
        if not any(c.isalpha() for c in letters):
            return m[0]
        whole = decode(letters, model, swap)
        if m[1] == " " and letters[0] in "aAiI" and len(letters) > 3:  # perhaps a word of its own
            rest = decode(letters[1:], model, swap)
            if likelihood(letters[0].lower(), model) + likelihood(rest, model) > likelihood(whole, model):
                return f"{letters[0]} {rest}"
        return whole

    mixed, repeated, apart = _suspicious(text)
    if apart:
        text = _APART.sub(join, text)
    if mixed:
        text = _MIXED.sub(clear, text)
    if repeated:
        text = _REPEATED.sub(clear, text)
    return text


def restored(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, text`` with the restored text; null stays null."""
    docs = pick(docs, "doc_id", "text")
    model, swap = language_model(docs), settings.swap
    run = text_udf(lambda texts: pa.array([x and restore(x, model, swap) for x in texts], pa.string()), "string")
    return docs.select("doc_id", run("text").alias("text"))


# The classifier.


def words(text: str) -> set[bytes]:
    return set(text.encode(errors="surrogatepass").translate(_WORDS).split())


def features(word: bytes, settings: Settings) -> list[int]:
    """Hashes of a word and of its beginnings."""
    parts = [word + b"$", *(word[:n] for n in settings.prefixes if len(word) > n)]
    return [xxhash.xxh3_64_intdigest(x) >> 1 for x in parts]


def summary(text: str | None, weight_of: Callable[[bytes], float]) -> tuple[float, float, float, float]:
    """Of the words' weights: largest, second largest, sum of the positive, sum of the negative."""
    weights = sorted((w for w in map(weight_of, words(text or "")) if w), reverse=True)
    top = [*weights[:2], 0.0, 0.0]
    return max(top[0], 0.0), max(top[1], 0.0), math.log1p(sum(w for w in weights if w > 0)), math.log1p(-sum(w for w in weights if w < 0))


class Weights(dict):
    """Weight of each word: its feature of the largest size. Fills as words come, and empties."""

    def __init__(self, table: dict[int, float], settings: Settings):
        self.table, self.settings = table, settings

    def __missing__(self, word: bytes) -> float:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = max((self.table.get(x, 0.0) for x in features(word, self.settings)), key=abs)
        return value


@dataclass(frozen=True)
class Model:
    trigrams: np.ndarray
    weights: dict[int, float]
    """Log odds of features, of those where they are significant."""
    coefficients: np.ndarray
    """Of the summary's four numbers and 1, to the log odds of label 1."""


def _sampled(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """``text, toxic``: as many rows as the settings allow, those with the lowest hash of the id."""
    marks = pick(labels, "doc_id", "toxic").filter("doc_id is not null and toxic is not null")
    marks = marks.filter(~held_out(F.col("doc_id"), 3, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    each = settings.sample_rows // 2
    halves = [marks.filter(F.col("toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for x in (0, 1)]
    return docs.join(F.broadcast(halves[0].union(halves[1])), "doc_id").select("text", "toxic")


ALL = -1
"""Counts as a feature that every document has."""


def _log_odds(sample: DataFrame, trigrams: np.ndarray, settings: Settings) -> dict[int, float]:
    """Log odds between the labels of features that differ by ``z`` standard errors."""

    def run(batches):
        found: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        for batch in small(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = {x for w in words(restore(text or "", trigrams, settings.swap)) for x in features(w, settings)}
                found[toxic].append(np.fromiter([*own, ALL], np.int64, len(own) + 1))
        for toxic in (0, 1):
            seen, n = np.unique(np.concatenate([np.zeros(0, np.int64), *found[toxic]]), return_counts=True)
            none = np.zeros(len(n), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(none if toxic else n), pa.array(n if toxic else none)], ["feature", "clean", "toxic"])

    rows = sample.mapInArrow(run, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rows = stage(rows.filter("clean + toxic >= 3"))
    total = rows.filter(F.col("feature") == ALL).first()
    if total is None:
        return {}

    def logit(n, of):
        return F.log((F.col(n) + 0.5) / (of + 1 - F.col(n)))

    odds = logit("toxic", total.toxic) - logit("clean", total.clean)
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    kept = rows.filter(F.col("feature") != ALL).withColumn("odds", odds).filter(F.abs("odds") > settings.z * error)
    return {r.feature: r.odds for r in kept.select("feature", "odds").collect()}


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps, lightly held to zero."""
    x = np.column_stack((x, np.ones(len(x))))
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(b))
        b = b + np.clip(np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.1 * b), -5, 5)
    return b


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    docs = pick(docs, "doc_id", "text")
    trigrams = language_model(docs)
    sample = _sampled(docs, labels, settings)
    table = _log_odds(sample, trigrams, settings)

    def run(texts):
        weights = Weights(table, settings)
        rows = [summary(restore(x or "", trigrams, settings.swap), weights.__getitem__) for x in texts]
        return pa.array([list(r) for r in rows], pa.list_(pa.float64()))

    rows = sample.select("toxic", text_udf(run, "array<double>")("text").alias("x")).collect()
    if not rows:
        return Model(trigrams, table, np.array([0, 0, 0, 0, -5.0]))
    rows.sort(key=lambda r: (r.toxic, list(r.x)))
    y = np.array([r.toxic for r in rows], float)
    return Model(trigrams, table, _logistic(np.array([list(r.x) for r in rows]), y, np.ones(len(y))))


def score(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs(doc_id, text)``.

    ``labels(doc_id, toxic)`` teach from ids that aren't held out; of repeated labels the larger
    counts, and null ids or labels teach nothing. Null and empty texts get the score of a text
    without words. Repeated rows are scored each. Without any label all get a score near zero.
    An empty table gives no rows.
    """
    model = fit(docs, labels, settings)

    def run(texts):
        weights = Weights(model.weights, settings)
        known: dict[str, str] = {}
        x = np.array([[*summary(restore(t or "", model.trigrams, settings.swap, known), weights.__getitem__), 1.0] for t in texts]).reshape(-1, 5)
        return pa.array(1 / (1 + np.exp(-np.clip(x @ model.coefficients, -30, 30))), pa.float64())

    found = pick(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), text_udf(run, "double", 4 << 20)("text").alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

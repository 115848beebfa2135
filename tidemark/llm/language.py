"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its hashed byte n-grams; a linear softmax reads the
average. Both are trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows. A held-back part of the sample sets the temperature and the rejection threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, pick, place_of, text_udf, unnamed

UNDETERMINED = "und"
_LOWERED = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 12
    orders: tuple[int, ...] = (2, 3, 4)
    width: int = 16
    sample_rows: int = 4_000
    """Labelled rows that the fit may read, over all languages; the rest only get predictions."""
    epochs: int = 8
    rate: float = 0.5
    keep_share: float = 0.995
    """Share of rightly recognised rows that the rejection accepts, measured on calibration rows."""
    seed: int = 7


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray
    """Per bucket its embedding times the softmax weights: averages of rows are logits."""
    bias: np.ndarray
    temperature: float
    threshold: float


def grams(data: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Hash bucket of the byte n-gram that starts at each place."""
    n = len(data) - order + 1
    code = np.full(max(n, 0), order, np.uint32)
    for i in range(order):
        code = code * np.uint32(0x01000193) ^ data[i : i + max(n, 0)]
    code *= np.uint32(0x9E3779B1)
    return code >> np.uint32(32 - int(buckets).bit_length() + 1)


def _bytes(text: str) -> bytes:
    return b" " + text.encode(errors="surrogatepass").translate(_LOWERED) + b"   "


def text_logits(texts: list[str], model: Model, settings: Settings) -> np.ndarray:
    """Uncalibrated logits of each text: the average of the table rows of its n-grams."""
    parts = [_bytes(x) for x in texts]
    data, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([*map(len, parts)])
    starts = np.concatenate(([0], ends[:-1]))
    table = np.vstack((model.table, np.zeros_like(model.table[:1])))
    total, count = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    for order in settings.orders:
        codes = np.full(len(data), settings.buckets, np.int64)
        codes[: len(data) - order + 1] = grams(data, order, settings.buckets)
        for back in range(1, order):  # these reach into the next text
            codes[ends - back] = settings.buckets
        total += np.add.reduceat(table[codes], starts, axis=0, dtype=np.float64)
        count += ends - starts - order + 1
    return total / count[:, None] + model.bias


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _of_all(share: np.ndarray) -> np.ndarray:
    """Shares of all n-grams of the text."""
    return share / share.sum(axis=1, dtype=np.float32, keepdims=True)


def _sample(docs: DataFrame, settings: Settings) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, and of the sampled rows their language and the share of each bucket.

    Sampled are the rows with the lowest hash of the id, equally many of each language. Tasks
    turn them into bucket counts, so the driver gets at most ``sample_rows`` times ``buckets``
    numbers, however long the texts are.
    """
    learn = docs.filter(~F.col("held_out") & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {x.lang: x.n for x in learn.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return [], np.zeros((0, settings.buckets), np.float16), np.zeros(0, int)
    each = max(1, settings.sample_rows // len(languages))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # Hashes are even, so a share of them holds enough rows, and a frequent language isn't sorted whole.
    share = F.element_at(F.create_map(*[F.lit(y) for x, n in counts.items() for y in (x, min(1.0, 4 * each / n))]), F.col("lang"))
    low = F.xxhash64("doc_id").cast("double") < (share * 2 - 1) * 2.0**63
    ids = learn.filter(low | (share >= 1)).select("doc_id", "lang").distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= each)
    chosen = learn.join(F.broadcast(ids.select("doc_id", "lang")), ["doc_id", "lang"]).select("doc_id", "lang", "text")

    def count(texts):
        out = []
        for text in texts:
            data = np.frombuffer(_bytes(text), np.uint8)
            seen = sum(np.bincount(grams(data, n, settings.buckets), minlength=settings.buckets) for n in settings.orders)
            out.append((seen / seen.max()).astype("<f2").tobytes())
        return pa.array(out, pa.binary())

    rows = chosen.select("doc_id", "lang", text_udf(count, "binary")("text").alias("share")).dropDuplicates(["doc_id", "lang"]).collect()
    rows.sort(key=lambda r: (r.doc_id, r.lang))
    share = np.empty((len(rows), settings.buckets), np.float16)  # of the most frequent bucket
    for i, r in enumerate(rows):
        share[i] = np.frombuffer(r.share, "<f2")
    place = {x: i for i, x in enumerate(languages)}
    return languages, share, np.array([place[r.lang] for r in rows])


def rejection(right: np.ndarray, keep_share: float) -> float:
    """Largest threshold under which a further right row falls with at most ``1 - keep_share``.

    The k-th lowest of n scores has a chance of k / (n + 1) above a further one. With too few
    rows for k = 1 nothing can be promised, so nothing is rejected.
    """
    k = int(round((1 - keep_share) * (len(right) + 1), 9))
    return float(np.partition(right, k - 1)[k - 1]) if k else 0.0


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Trains on rows of ``docs(doc_id, text, lang, held_out)`` that are not held out."""
    languages, share, wanted = _sample(docs, settings)
    n, classes = len(wanted), len(languages)
    random = np.random.default_rng(settings.seed)
    places = random.permutation(n)
    back, learn = places[: n // 5], places[n // 5 :]
    embed = random.normal(0, 0.1, (settings.buckets, settings.width)).astype(np.float32)
    weights = random.normal(0, 0.1, (settings.width, classes)).astype(np.float32)
    bias = np.zeros(classes, np.float32)
    target = np.eye(classes, dtype=np.float32)[wanted] if n else np.zeros((0, classes), np.float32)
    scale = np.float32(settings.buckets**0.5)  # shares of single buckets are small
    for epoch in range(settings.epochs):
        rate = settings.rate * (1 - epoch / settings.epochs)
        learn = random.permutation(learn)
        for at in range(0, len(learn), 32):
            rows = learn[at : at + 32]
            x = scale * _of_all(share[rows])
            hidden = x @ embed
            error = (_softmax(hidden @ weights + bias) - target[rows]) / np.float32(len(rows))
            down = error @ weights.T
            steps = hidden.T @ error, error.sum(axis=0), x.T @ down
            size = np.float32(rate / max(1.0, np.sqrt(sum(float((g * g).sum()) for g in steps))))  # clipped
            weights -= size * steps[0]
            bias -= size * steps[1]
            embed -= size * steps[2]
    table = (embed @ weights * scale).astype(np.float32)
    temperature, threshold = 1.0, 0.0
    if len(back):
        logits = _of_all(share[back]) @ table + bias
        losses = {t: -np.log(_softmax(logits / t)[np.arange(len(back)), wanted[back]] + 1e-12).mean() for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0)}
        temperature = min(losses, key=losses.get)
        sure = _softmax(logits / temperature)
        threshold = rejection(sure.max(axis=1)[sure.argmax(axis=1) == wanted[back]], settings.keep_share)
    return Model(languages, table, bias.astype(np.float64), temperature, threshold)


def _found(docs: DataFrame, settings: Settings) -> DataFrame:
    """``docs`` with columns by number, and ``found``: language, score, whether it is rejected."""
    learn = pick(docs, "doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id"), 5, 0))
    model = fit(learn, settings)

    def predict(texts):
        langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        real = [i for i, x in enumerate(texts) if x is not None and model.languages]
        if real:
            sure = _softmax(text_logits([texts[i] for i in real], model, settings) / model.temperature)
            scores[real] = sure.max(axis=1)
            for i, k in zip(real, sure.argmax(axis=1), strict=True):
                langs[i] = model.languages[k]
        refused = [x == UNDETERMINED or s < model.threshold for x, s in zip(langs, scores, strict=True)]
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores), pa.array(refused, pa.bool_())], ["lang_pred", "score", "rejected"])

    text = F.col(place_of(docs, "text"))
    run = text_udf(predict, "struct<lang_pred:string,score:double,rejected:boolean>")
    return unnamed(docs).withColumn("found", run(F.when(text.rlike(r"\p{L}"), text)))


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for each row of ``docs(doc_id, text, lang)``.

    Null text, empty text and text without a letter get ``und``, score 0, and are rejected; so
    are rows whose calibrated probability is under the threshold (they keep their language).
    Rows with a null id or null language are predicted but not learnt from. Without any row to
    learn from, all are ``und``. Repeated rows are predicted each; equal texts get equal results.
    An empty table gives no rows.
    """
    doc_id = F.col(place_of(docs, "doc_id"))
    return _found(docs, settings).select(doc_id.alias("doc_id"), held_out(doc_id, 5, 0).alias("held_out"), "found.*")


def accepted(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that ``identify`` doesn't reject, with all their columns."""
    return _found(docs, settings).filter("not found.rejected").drop("found").toDF(*docs.columns)

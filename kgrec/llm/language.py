"""Language identification by averaged hashed subword embeddings and a linear softmax (operator 7).

A text's subwords are the 1- to 4-grams of code points inside its lower-cased letter runs, the run's borders included,
hashed into ``BUCKETS`` rows of an embedding table.  The mean of the embeddings goes through a linear softmax; both
are trained by stochastic gradient descent in numpy.  Probabilities are calibrated by a temperature on a held-back part of
the sample, and a document is rejected if its calibrated score falls below what nearly all held-back documents
of its kind reach.

The fit uses a bounded sample: of each labelled language the ``PER_LANGUAGE`` distinct texts of smallest hash, and fewer of each
where there are more languages than ``SAMPLE_TEXTS`` has room for (one at least), each as at most ``BUCKETS`` counts made from its
whole text.  Every labelled language can be predicted.  Prediction reads every whole text.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; rows with a null language
or text are not learned from; repeated rows each get their prediction; without a labelled row every text is
``und``; an empty table gives an empty result; id, source and language are never read by a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from kgrec.llm.common import keyed_rows, with_fields, written

BUCKETS = 1 << 16
DIM = 16
GRAMS = (1, 2, 3, 4)
PER_LANGUAGE = 600
SAMPLE_TEXTS = 120_000   # texts of the whole sample, about
EPOCHS = 8
RATE = 0.5
SEED = 3
CHUNK = 1 << 18        # code points whose n-grams are hashed at once
KEEP_SHARE = 0.999     # of rightly predicted held-back documents that the rejection must keep
MOST_REJECT = 0.5      # no score above this is rejected
MULTIPLIER = 0x9E3779B97F4A7C15
KNOWN = 0x3000
HASHES = 1 << 52
LETTER = np.array([chr(c).isalpha() for c in range(KNOWN)])


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points, 0 in place of what is no letter, 0 at both ends."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    low = raw < KNOWN
    letter = LETTER[np.where(low, raw, 0)]
    if not low.all():
        far, at = np.unique(raw[~low], return_inverse=True)
        letter[~low] = np.array([chr(c).isalpha() for c in far.tolist()])[at]
    out = np.zeros(len(raw) + 2, np.uint64)
    out[1:-1] = np.where(letter, raw, 0)
    return out


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of a whole text's subwords, chunk by chunk."""
    if not text:
        return
    codes = _codes(text)
    longest = max(GRAMS)
    for at in range(0, len(codes), CHUNK):
        here = codes[at:at + CHUNK + longest - 1]
        h, inner = np.zeros(len(here), np.uint64), np.ones(len(here), bool)
        for n in range(1, longest + 1):
            m = len(here) - n + 1
            if m <= 0:
                break
            if n > 2:  # only a border may be no letter
                inner = inner[:m] & (here[n - 2:n - 2 + m] > 0)
            h = (h[:m] + here[n - 1:] + np.uint64(1)) * np.uint64(MULTIPLIER)
            h ^= h >> np.uint64(29)
            ok = inner[:m] & ((here[:m] > 0) & (here[n - 1:] > 0) if n < 3 else (here[n - 2:n - 2 + m] > 0) & ((here[:m] > 0) | (here[1:1 + m] > 0)))
            ok[CHUNK:] = False  # those start in the next chunk
            if n in GRAMS:
                yield (h[ok] >> np.uint64(48)).astype(np.int64) % BUCKETS


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray        # BUCKETS x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float

    def score(self, text: str | None) -> tuple[str, float]:
        total, n = np.zeros(len(self.languages)), 0
        for b in grams(text):
            total += self.table[b].sum(axis=0, dtype=np.float64)
            n += len(b)
        if not n or not self.languages:
            return "und", 0.0
        p = _softmax((total / n + self.bias) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(samples: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_languages: int,
          epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Stochastic gradient descent over ``(buckets, counts)``; every step thins a text to a random length, so that short
    texts are learned too.  Returns the embeddings folded with the softmax weights, and the bias."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, n_languages), np.float32), np.zeros(n_languages, np.float32)
    steps = epochs * len(samples)
    for step, i in enumerate(i for _ in range(epochs) for i in rng.permutation(len(samples))):
        buckets, counts = samples[i]
        c = counts.astype(np.float32)
        if step % 2:
            c = rng.binomial(counts, min(1.0, rng.uniform(20, 400) / counts.sum())).astype(np.float32)
            if not c.any():
                continue
        c /= c.sum()
        v = c @ emb[buckets]
        g = _softmax(v @ out + bias)
        g[y[i]] -= 1
        lr = rate * (1 - step / steps)
        back = out @ g
        out -= lr * np.outer(v, g)
        bias -= lr * 0.1 * g
        emb[buckets] -= (lr * len(buckets) ** 0.5) * np.outer(c, back)
    return emb @ out, bias


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, sample_texts: int = SAMPLE_TEXTS) -> Model:
    """Fits on rows of ``text`` and ``lang``."""
    named = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).dropna()
    texts = named.groupBy("lang").agg(F.approx_count_distinct("text").alias("n_texts"))
    texts = written(texts, "languages")  # a row a language
    per_language = max(1, min(per_language, sample_texts // max(1, texts.count())))
    first = F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))
    # Copies of a text count once.  Hashes are uniform: those below twice the wanted share of texts hold the smallest ``per_language``, and only they move.
    low = F.col("h") < F.lit(2.0 * per_language * HASHES) / F.col("n_texts")
    sample = (named.join(texts, "lang").withColumn("h", F.pmod(F.xxhash64(F.lit(SEED), "text"), F.lit(HASHES)))
              .filter(low).select("lang", "h", "text").distinct().withColumn("n", first).filter(F.col("n") <= per_language).select("lang", "h", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(np.concatenate([np.empty(0, np.int64), *grams(t.as_py())]), return_counts=True) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("lang"), b.column("h"), pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())),
                 pa.array([f[1].astype(np.int32) for f in found], pa.list_(pa.int32()))], ["lang", "h", "buckets", "counts"])

    found = sample.mapInArrow(count, "lang string, h bigint, buckets array<int>, counts array<int>").toArrow().combine_chunks()  # the bounded sample
    lists = {c: found.column(c).combine_chunks() for c in ("buckets", "counts")}  # kept as the two buffers that they came in
    ends = {c: v.offsets.to_numpy() for c, v in lists.items()}
    values = {c: v.values.to_numpy(zero_copy_only=False) for c, v in lists.items()}
    langs, hashes = found.column("lang").to_pylist(), found.column("h").to_pylist()
    order = sorted((k for k in range(len(langs)) if ends["buckets"][k + 1] > ends["buckets"][k]), key=lambda k: (hashes[k], langs[k]))
    languages = sorted({langs[k] for k in order})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    xs = [tuple(values[c][ends[c][k]:ends[c][k + 1]] for c in ("buckets", "counts")) for k in order]
    y = np.array([languages.index(langs[k]) for k in order])
    back = np.array([hashes[k] % 5 == 0 for k in order])
    if back.all() or len(set(y[~back])) < len(languages):
        back[:] = False
    own = np.flatnonzero(~back)
    table, bias = train([xs[i] for i in own], y[own], len(languages))
    held = np.flatnonzero(back) if back.any() else own
    z = np.array([c @ table[b] / c.sum() + bias for b, c in (xs[i] for i in held)])
    heats = np.geomspace(0.1, 10, 41)
    loss = [-np.log(_softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in heats]
    heat = float(heats[int(np.argmin(loss))])
    p = _softmax(z / heat)
    right = p.max(axis=1)[p.argmax(axis=1) == y[held]]
    least = min(MOST_REJECT, float(np.quantile(right, 1 - KEEP_SHARE))) if len(right) else 0.0
    return Model(languages, table.astype(np.float32), bias, heat, least)


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep``, ``lang_pred``, ``score`` and ``rejected`` of every row; only ``text`` is read for it."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers, whatever the corpus
    schema = with_fields(docs.select(*[F.col(f"`{c}`") for c in keep]).schema,
                         lang_pred=T.StringType(), score=T.DoubleType(), rejected=T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            found = [m.score(t.as_py()) for t in b.column(len(keep))]
            pred, score = [f[0] for f in found], [f[1] for f in found]
            rejected = [p == "und" or s < m.reject_below for p, s in found]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(rejected, pa.bool_())], schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("language_text")).mapInArrow(run, schema)


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not reject."""
    keyed = keyed_rows(docs)
    good = written(predict(keyed.select("key", F.col("row.text").alias("text")), model, ["key"]).filter("not rejected").select("key"), "language-kept")
    return keyed.join(good, "key", "left_semi").select("row.*")

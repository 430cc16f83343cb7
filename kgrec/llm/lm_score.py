"""Masked pseudo-likelihood scores from a bidirectional window network (operator 1).

A token is predicted from the two before and the two after it: their position-wise embeddings are summed and squashed,
and a factored softmax gives p(high | window) * p(low | window, high), which covers ``VOCABULARY = SIDE ** 2``
classes at the cost of 2 * SIDE.  A document's score is the sum of the log-probabilities of all its tokens, each
hidden in its turn.

Classes: the most frequent words of the whole corpus one each, the other words by hash into ``RARE`` classes, and one for
the borders.  A word of a shared class has log(count(word) / (count(class) + 1)) added, from counts of all words of the
corpus; the one is kept for words that the corpus lacks.  The counts of about ``HEAD`` words are sent to the tasks, those of
all others are joined.  Training is data-parallel: in each round every task trains a copy of the network in numpy on all of its
documents and the copies are averaged by their number of tokens, in two levels.

Defined results: a null text is an empty one with 0 tokens and score 0 (mean null); documents without an id are
scored like any other; repeated rows each get their score; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgrec.llm.common import written

SIDE = 64
VOCABULARY = SIDE * SIDE
RARE = 512
HEAD = 200_000         # words of shared classes whose counts tasks hold, at most
COUNTED = 200_000      # distinct words that a task counts before it passes them on
LOGS = 1e9             # joined logarithms are summed as whole numbers of this part, in any order the same
BORDER = 0
REACH = 2
DIM = 24
ROUNDS = 1             # passes over all documents
BATCH = 1024
RATE = 0.3
SEED = 1
CHUNK = 1 << 15        # tokens scored at once
SHAPES = {"emb": (2 * REACH, VOCABULARY, DIM), "bias": (DIM,), "high": (DIM, SIDE), "high_bias": (SIDE,), "join": (SIDE, DIM),
          "low": (DIM, SIDE), "low_bias": (SIDE,)}
STEPS = np.array([*range(-REACH, 0), *range(1, REACH + 1)])


def start(seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {k: (rng.normal(0, 0.1, s) if "bias" not in k else np.zeros(s)).astype(np.float32) for k, s in SHAPES.items()}


def flat(net: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in SHAPES])


def unflat(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        out[k], at = values[at:at + int(np.prod(s))].reshape(s).astype(np.float32), at + int(np.prod(s))
    return out


def split(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def word_counts(docs: DataFrame) -> DataFrame:
    """``(w, n)`` of every word of all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["w", "n"])

        for b in batches:
            for t in b.column(0):
                found.update(split(t.as_py()))
                if len(found) > COUNTED:
                    yield out()
                    found.clear()
        yield out()

    counted = docs.select("text").mapInArrow(run, "w binary, n bigint")
    return written(counted.groupBy("w").agg(F.sum("n").alias("n")), "lm-words")


def vocabulary(counts: DataFrame) -> dict[bytes, int]:
    """The most frequent words and their classes; at most ``VOCABULARY`` rows reach the driver."""
    top = counts.orderBy(F.desc("n"), "w").limit(VOCABULARY - RARE - 1)
    return {bytes(r["w"]): k + 1 for k, r in enumerate(top.select("w").collect())}


def shares(counts: DataFrame, classes: dict[bytes, int]) -> tuple[dict[bytes, float], np.ndarray]:
    """log p(word | its shared class) of the ``HEAD`` most frequent words outside ``classes`` (fewer where counts tie), and the
    log-probability of a word that a class lacks, for each of the ``RARE`` classes."""
    sent = counts.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RARE, np.int64)
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if w not in sent.value:
                    total[rare(w)] += n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(RARE)), pa.array(total)], ["k", "n"])

    total = np.zeros(RARE)
    for r in counts.mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect():  # ``RARE`` rows
        total[r["k"]] = r["n"]
    unseen = -np.log(total + 1)
    # How many words have about each count; the most frequent words come from the counts that few enough words reach.
    size = F.floor(F.log("n") * 32)
    words, least = 0, None
    for r in sorted(counts.groupBy(size.alias("size")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["size"]):  # under 1500 rows
        words += r["words"]
        if words > HEAD + len(classes):
            break
        least = r["size"]
    head = [] if least is None else counts.filter(size >= least).collect()
    named = ((bytes(r["w"]), r["n"]) for r in head)
    return {w: log(n) + float(unseen[rare(w)]) for w, n in named if w not in classes}, unseen


def rare(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word) % RARE


class Classes(dict):
    """Words to classes; other words are hashed, and kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        k = VOCABULARY - RARE + rare(word)
        if len(self) < 300_000:
            self[word] = k
        return k


def tokens(text: str | None, classes: Classes) -> np.ndarray:
    words = split(text)
    return np.fromiter(map(classes.__getitem__, words), np.int64, len(words))


def within(words: list[bytes], ids: np.ndarray, known: dict[bytes, float], unseen: np.ndarray) -> tuple[float, Counter]:
    """Sum of log p(word | its shared class), but for the log(count) of the words returned, whose counts are not at hand."""
    total, others = 0.0, Counter()
    for i in np.flatnonzero(ids >= VOCABULARY - RARE).tolist():
        share = known.get(words[i])
        if share is None:
            others[words[i]] += 1
            share = float(unseen[ids[i] - VOCABULARY + RARE])
        total += share
    return total, others


def windows(ids: np.ndarray, first: int, last: int) -> np.ndarray:
    """Classes around the tokens ``first`` to ``last``; borders are padded."""
    padded = np.concatenate([np.full(REACH, BORDER), ids, np.full(REACH, BORDER)])
    return padded[np.arange(first, last)[:, None] + REACH + STEPS]


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def forward(net: dict, around: np.ndarray, ids: np.ndarray) -> tuple:
    h = np.tanh(sum(net["emb"][j][around[:, j]] for j in range(2 * REACH)) + net["bias"])
    high, low = ids // SIDE, ids % SIDE
    g = h + net["join"][high]
    return h, g, high, low, _log_softmax(h @ net["high"] + net["high_bias"]), _log_softmax(g @ net["low"] + net["low_bias"])


def log_likelihood(net: dict, ids: np.ndarray) -> float:
    """Sum over all tokens of log p(token | window)."""
    total = 0.0
    for at in range(0, len(ids), CHUNK):
        end = min(len(ids), at + CHUNK)
        *_, high, low, p, q = forward(net, windows(ids, at, end), ids[at:end])
        rows = np.arange(end - at)
        total += float(p[rows, high].sum(dtype=np.float64) + q[rows, low].sum(dtype=np.float64))
    return total


def step(net: dict, around: np.ndarray, ids: np.ndarray, rate: float) -> float:
    """One step of gradient descent on the mean loss of a batch; returns that loss."""
    h, g, high, low, p, q = forward(net, around, ids)
    rows, n = np.arange(len(ids)), len(ids)
    loss = -float((p[rows, high] + q[rows, low]).mean())
    dp, dq = np.exp(p), np.exp(q)
    dp[rows, high] -= 1
    dq[rows, low] -= 1
    dg = dq @ net["low"].T
    dh = (dp @ net["high"].T + dg) * (1 - h * h)
    scale = rate / n
    net["low"] -= scale * (g.T @ dq)
    net["high"] -= scale * (h.T @ dp)
    net["low_bias"] -= scale * dq.sum(axis=0)
    net["high_bias"] -= scale * dp.sum(axis=0)
    net["bias"] -= scale * dh.sum(axis=0)
    _scatter(net["join"], high, dg, scale)
    for j in range(2 * REACH):
        _scatter(net["emb"][j], around[:, j], dh, scale * SIDE)
    return loss


def _scatter(table: np.ndarray, rows: np.ndarray, grads: np.ndarray, scale: float) -> None:
    """Subtracts each row's gradient sum; a row's step is damped by how often it occurs, so frequent rows stay stable."""
    order = np.argsort(rows.astype(np.int16), kind="stable")  # a radix sort
    own = rows[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    own, n = own[first], np.diff(np.r_[first, len(own)])
    table[own] -= scale / np.sqrt(n)[:, None].astype(np.float32) * np.add.reduceat(grads[order], first, axis=0)


def train_round(docs: DataFrame, classes: dict[bytes, int], net: dict, seed: int, rate: float) -> dict:
    """One pass of every task over its documents, then the average of the copies."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((classes, flat(net)))
    block = 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = sent.value
        own, words, seen = unflat(values.copy()), Classes(known), 0
        rng = np.random.default_rng(seed)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                parts = [x for x in (tokens(t.as_py(), words) for t in b.column(0).slice(at, 64)) if len(x)]
                if not parts:
                    continue
                ids = np.concatenate(parts)
                around = np.concatenate([windows(x, 0, len(x)) for x in parts])
                order = rng.permutation(len(ids))
                for k in range(0, len(ids), BATCH):
                    pick = order[k:k + BATCH]
                    step(own, around[pick], ids[pick], rate)
                seen += len(ids)
        if seen:
            out = flat(own)
            n = -(-len(out) // block)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(n)), pa.array(np.full(n, TaskContext.get().partitionId())), pa.array(np.full(n, float(seen))),
                 pa.array([out[k * block:(k + 1) * block] for k in range(n)], pa.list_(pa.float32()))], ["block", "part", "w", "v"])

    schema = "block bigint, part bigint, w double, v array<float>"

    def average(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        w = group["w"].to_numpy()
        mean = sum(x * np.asarray(v, float) for x, v in zip(w, group["v"], strict=True)) / w.sum()
        return pd.DataFrame({"block": group["block"].iloc[:1], "part": group["part"].iloc[:1], "w": [w.sum()], "v": [mean.astype(np.float32)]})

    copies = written(docs.select("text").mapInArrow(run, schema), "lm-copies")
    n_parts = copies.select("part").distinct().count()
    some = copies.groupBy("block", (F.col("part") % max(1, int(n_parts ** 0.5))).alias("some"))
    halfway = some.applyInPandas(lambda g: average(g), schema)
    rows = halfway.groupBy("block").applyInPandas(average, schema).orderBy("block").select("v").collect()  # one network
    return unflat(np.concatenate([np.array(r["v"], np.float32) for r in rows])) if rows else net


def learn(docs: DataFrame, rounds: int = ROUNDS, counts: DataFrame | None = None) -> tuple[dict[bytes, int], dict]:
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    classes, net = vocabulary(word_counts(named) if counts is None else counts), start()
    for k in range(rounds):
        net = train_round(named, classes, net, SEED + k, RATE / (k + 1))
    return classes, net


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, n_tokens, log_prob, mean_log_prob)`` of every row's whole text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = word_counts(rows)
    classes, net = learn(rows, rounds, counts)
    sent = docs.sparkSession.sparkContext.broadcast((classes, net, *shares(counts, classes)))  # all of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, net, head, unseen = sent.value
        classes, row = Classes(known), TaskContext.get().partitionId() << 40
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                n, total, rest = [], [], []
                for t in part.column(1):
                    words = split(t.as_py())
                    ids = np.fromiter(map(classes.__getitem__, words), np.int64, len(words))
                    more, others = within(words, ids, head, unseen)
                    n.append(len(ids))
                    total.append(log_likelihood(net, ids) + more)
                    rest.append([{"w": w, "times": k} for w, k in others.items()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + len(n))), part.column(0), pa.array(n, pa.int64()), pa.array(total, pa.float64()),
                     pa.array(rest, pa.list_(pa.struct([("w", pa.binary()), ("times", pa.int64())])))],
                    ["row", "doc_id", "n_tokens", "log_prob", "rest"])
                row += len(n)

    schema = "row bigint, doc_id bigint, n_tokens bigint, log_prob double, rest array<struct<w:binary,times:bigint>>"
    scored = written(rows.mapInArrow(run, schema), "lm-scored")
    logs = counts.filter("n > 1").select("w", F.round(F.log("n") * LOGS).cast("bigint").alias("log"))  # the logarithm of 1 adds nothing
    joined = scored.select("row", F.explode("rest").alias("r")).select("row", "r.w", "r.times").join(logs, "w")
    more = joined.groupBy("row").agg((F.sum(F.col("times") * F.col("log")) / LOGS).alias("more"))
    whole = scored.drop("rest").join(more, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0)))
    return whole.select("doc_id", "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))

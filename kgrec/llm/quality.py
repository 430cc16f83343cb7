"""Quality rules as a learned decision list (operator 9).

``statistics``  exact counts of every whole text, no shuffle.
``learn``       sequential covering on labelled statistics: a rule for rejection grows, one threshold condition at a time,
                by information gain on the growing part of the sample; it is pruned from its last condition on the
                pruning part; accepted rules take their rows out and the next rule is grown on the rest.
``verdict``     the list as one Spark conditional expression, rules in their order.

The fit uses a bounded sample: the ``SAMPLE_ROWS`` labelled rows of smallest id hash.  A rule must be right for at
least ``PRECISION`` of the pruning rows it covers, so that clean documents stay.

Defined results: a null text has no words; rows without words fail the base rule; labels without a document, documents
without a label and null labels are not learned from, and an id with several labels counts once for each; repeated rows
each get their verdict; without labels, or without both classes, the list is empty and the base rule alone decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgrec.llm.common import LETTERS, keyed_rows, with_fields, written

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SAMPLE_ROWS = 20_000
PRECISION = 0.95
LEAST_ROWS = 5       # growing rows that a rule must cover
THRESHOLDS = 64      # candidate thresholds of a feature, at quantiles of its values
SEED = 9

FEATURES = {
    "n_words": "n_words",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines_per_100_words": "100.0 * n_dup_lines / greatest(n_words, 1)",
    "n_dup_lines": "n_dup_lines",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}


def text_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes: ASCII white space only
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, LETTERS))
    kept = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return n, chars, symbols, len(kept) - len(set(kept)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, window, n = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = n[window] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k:len(words) - 2 + k] |= twice
    return int(inside.sum())


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the five counts of every row's whole text."""
    names = [*keep, *STATS]
    schema = with_fields(docs.select(*[F.col(f"`{c}`") for c in keep]).schema, **dict.fromkeys(STATS, T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = np.array([text_statistics(t.as_py()) for t in b.column(len(keep))], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], *(pa.array(c.copy()) for c in counts.T)], names)

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("quality_text")).mapInArrow(run, schema)


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


Rule = list[tuple[str, str, float]]  # conditions: feature, "<=" or ">=", threshold


def _covered(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for feature, op, at in rule:
        out &= x[feature] <= at if op == "<=" else x[feature] >= at
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Conditions of largest information gain (FOIL's) until no good row is covered."""
    rule, here = [], np.ones(len(bad), bool)
    while (here & ~bad).any():
        p, n = int((here & bad).sum()), int((here & ~bad).sum())
        best = (0.0, None)
        for feature in x:
            values = x[feature][here]
            y = bad[here]
            for at in np.unique(np.quantile(values, np.linspace(0, 1, THRESHOLDS), method="nearest")):
                for op in ("<=", ">="):
                    c = values <= at if op == "<=" else values >= at
                    p1 = int((c & y).sum())
                    n1 = int(c.sum()) - p1
                    if p1 >= LEAST_ROWS and (p1, n1) != (p, n):
                        gain = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))
                        if gain > best[0] + 1e-9:
                            best = (gain, (feature, op, float(at)))
        if best[1] is None:
            break
        rule.append(best[1])
        here = _covered(rule, x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The leading conditions of largest (p - n) / (p + n) on the pruning rows; ties: the fewest."""
    def worth(r: Rule) -> float:
        c = _covered(r, x)
        p = int((c & bad).sum())
        n = int(c.sum()) - p
        return (p - n) / (p + n) if p + n else -1.0
    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth, default=[])


def cover(x: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray, precision: float = PRECISION) -> list[Rule]:
    """The decision list: rules for rejection in the order in which they were learned."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while True:
        grow, check = left & ~prune, left & prune
        if (grow & bad).sum() < LEAST_ROWS:
            return rules
        rule = _grow({f: v[grow] for f, v in x.items()}, bad[grow])
        rule = _prune(rule, {f: v[check] for f, v in x.items()}, bad[check])
        if not rule:
            return rules
        hit = _covered(rule, x)
        tried = hit & check
        if not tried.any() or (tried & bad).sum() < precision * tried.sum():
            return rules
        rules.append(rule)
        left &= ~hit


def learn(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learns from rows of ``doc_id`` and counts that pass the base rule and have a label in ``labels``."""
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    order = F.xxhash64(F.lit(SEED), "doc_id")
    rows = (stats.filter(~base_failed()).select("doc_id", *[F.expr(e).cast("double").alias(f"f_{f}") for f, e in FEATURES.items()])
            .join(marks, "doc_id").orderBy(order, "doc_id", "quality").limit(sample_rows)
            .withColumn("part", F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(3)))).toPandas()  # sample_rows at most
    if not len(rows):
        return []
    x = {f: rows[f"f_{f}"].to_numpy() for f in FEATURES}
    return cover(x, rows["quality"].to_numpy() == 0, rows["part"].to_numpy() == 0)


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional: false at the first rule that fits, true where none does."""
    out = F.lit(True)
    for rule in reversed(rules):
        fits = F.lit(True)
        for feature, op, at in rule:
            value = F.expr(FEATURES[feature]).cast("double")
            fits = fits & (value <= at if op == "<=" else value >= at)
        out = F.when(fits, F.lit(False)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` of every row; the counts are written once and learned from."""
    stats = written(statistics(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), ["doc_id"]), "quality-stats")
    rules = learn(stats, labels)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep.

    The narrow counts are written first and learned from; the kept rows are then found again by their row hashes.
    """
    keyed = keyed_rows(docs)
    named = keyed.select(F.col("row.doc_id").cast("bigint").alias("doc_id"), "key", F.col("row.text").alias("text"))
    stats = written(statistics(named, ["doc_id", "key"]), "quality-stats")
    good = stats.filter(~base_failed() & verdict(learn(stats, labels))).select("key")
    return keyed.join(good, "key", "left_semi").select("row.*")

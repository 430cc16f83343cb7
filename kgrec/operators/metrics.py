"""Ranking and beyond-accuracy metrics @k (E1-E7), per-user rows (A9), system means (A10).

Pinned definitions (binary relevance: test rating >= ``relevant_threshold``):

* precision  hits in the top-k / number of items listed (<= k)
* recall     hits / relevant test items of the user (0 when the user has none)
* f1         per-user harmonic mean of precision and recall (0 when both are 0), then averaged
* ndcg       DCG = sum rel_r / log2(r + 1) over the list; IDCG over the user's test scores sorted
             desc, first k; 0 when IDCG is 0
* epc        sum_r disc(r) * rel_r * (1 - pop(i)) / sum_r disc(r), pop(i) = train users of i / train users
* aplt       share of the list outside the ceil(20 %) most popular train items (ties by item id)
* gini       over items present in any list, x = times listed, sorted asc: sum (2i - n - 1) x_i / (n sum x)

All users with at least one prediction and one test row are averaged.  Every metric is computed for
all ``ks`` in one pass: rank once, then ``explode(ks)`` and keep rank <= k.

Scale notes: per-user work is a grouped aggregate (partial, map-side combine); Gini uses a histogram
of listing counts instead of sorting every item in one task; the popular-item cut uses the
distributed ``global_row_number``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgrec.functions.frames import attach_scalars
from kgrec.operators.rank import global_row_number, topk_per_user

METRICS = ("precision", "recall", "f1", "ndcg", "gini", "epc", "aplt")
USER_METRICS = ("precision", "recall", "f1", "ndcg", "epc", "aplt")
DEFAULT_KS = (5, 10)
LONG_TAIL_SHARE = (1, 5)   # popular head = ceil(1/5 of the train items), integer arithmetic
DIGITS = 6


def _disc(rank_col: str = "rank"):
    return F.lit(1.0) / F.log2(F.col(rank_col) + F.lit(1.0))


def item_popularity(train: DataFrame) -> DataFrame:
    """``(item_id, n_users, pop)``: distinct train users per item and its share of all train users."""
    n_users = train.select(F.countDistinct("user_id").alias("n_train_users"))
    per_item = train.groupBy("item_id").agg(F.countDistinct("user_id").alias("n_users"))
    return attach_scalars(per_item, n_users).select(
        "item_id", "n_users", (F.col("n_users") / F.col("n_train_users")).alias("pop"))


def popular_items(train: DataFrame, share: tuple[int, int] = LONG_TAIL_SHARE) -> DataFrame:
    """Items in the top ``ceil(num/den * n)`` by train popularity (ties: smaller item id first)."""
    num, den = share
    pop = train.groupBy("item_id").agg(F.countDistinct("user_id").alias("n_users"))
    ranked = global_row_number(pop, [F.col("n_users").desc(), F.col("item_id").asc()], "pos", start=1)
    n_items = pop.select(((F.count(F.lit(1)) * num + (den - 1)) / den).cast("bigint").alias("cut"))
    return attach_scalars(ranked, n_items).filter(F.col("pos") <= F.col("cut")).select("item_id")


def item_stats(train: DataFrame) -> DataFrame:
    """Train statistics per item: ``(item_id, n_users, pop, is_pop)`` (popularity and head membership)."""
    popular = popular_items(train).select("item_id", F.lit(1.0).alias("is_pop"))
    return (item_popularity(train).join(popular, "item_id", "left")
            .select("item_id", "n_users", "pop", F.coalesce("is_pop", F.lit(0.0)).alias("is_pop")))


def ranked_lists(preds: DataFrame, ks: Sequence[int] = DEFAULT_KS, group_cols: Sequence[str] = ("model",)) -> DataFrame:
    """Top-max(k) per (group, user), exploded to one row per k with rank <= k."""
    top = topk_per_user(preds, max(ks), group_cols=group_cols)
    return (top.withColumn("k", F.explode(F.array(*[F.lit(int(k)).cast("bigint") for k in ks])))
            .filter(F.col("rank") <= F.col("k")))


def user_metrics(preds: DataFrame, train: DataFrame, test: DataFrame, ks: Sequence[int] = DEFAULT_KS,
                 relevant_threshold: int = 1, group_cols: Sequence[str] = ("model",),
                 stats: DataFrame | None = None) -> DataFrame:
    """Per (group, k, user) metric rows (A9).  ``stats`` = precomputed ``item_stats(train)``."""
    g = list(group_cols)
    lists = ranked_lists(preds, ks, group_cols)
    truth = test.select("user_id", "item_id",
                        (F.col("rating") >= relevant_threshold).cast("double").alias("rel"))
    per_user_truth = truth.groupBy("user_id").agg(F.sum("rel").alias("n_rel"))
    stats = (stats if stats is not None else item_stats(train)).select("item_id", "pop", "is_pop")
    rows = (lists.join(truth, ["user_id", "item_id"], "left")
            .join(stats, "item_id", "left")
            .select(*g, "k", "user_id", "item_id", "rank",
                    F.coalesce("rel", F.lit(0.0)).alias("rel"),
                    F.coalesce("pop", F.lit(0.0)).alias("pop"),
                    F.coalesce("is_pop", F.lit(0.0)).alias("is_pop")))
    agg = rows.groupBy(*g, "k", "user_id").agg(
        F.count(F.lit(1)).alias("n_list"),
        F.sum("rel").alias("hits"),
        F.sum(F.col("rel") * _disc()).alias("dcg"),
        F.sum(_disc() * F.col("rel") * (F.lit(1.0) - F.col("pop"))).alias("epc_num"),
        F.sum(_disc()).alias("disc_sum"),
        F.sum(F.lit(1.0) - F.col("is_pop")).alias("n_tail"))
    agg = agg.join(per_user_truth, "user_id")  # users with >= 1 test row
    n_ideal = F.least(F.col("k"), F.col("n_rel").cast("int"))
    idcg = F.aggregate(F.sequence(F.lit(1), F.greatest(n_ideal, F.lit(1))), F.lit(0.0),
                       lambda acc, r: acc + F.when(r <= n_ideal, F.lit(1.0) / F.log2(r + F.lit(1.0)))
                       .otherwise(F.lit(0.0)))
    p = F.col("hits") / F.col("n_list")
    r = F.when(F.col("n_rel") > 0, F.col("hits") / F.col("n_rel")).otherwise(F.lit(0.0))
    out = agg.select(*g, "k", "user_id", p.alias("precision"), r.alias("recall"),
                     F.col("dcg"), idcg.alias("idcg"), "epc_num", "disc_sum", "n_tail", "n_list")
    return out.select(
        *g, "k", "user_id", "precision", "recall",
        F.when(F.col("precision") + F.col("recall") > 0,
               2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
        .otherwise(F.lit(0.0)).alias("f1"),
        F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(F.lit(0.0)).alias("ndcg"),
        (F.col("epc_num") / F.col("disc_sum")).alias("epc"),
        (F.col("n_tail") / F.col("n_list")).alias("aplt"))


def gini(preds: DataFrame, ks: Sequence[int] = DEFAULT_KS, group_cols: Sequence[str] = ("model",)) -> DataFrame:
    """Gini of listing counts per (group, k), from a histogram of counts.

    Items sharing a count x occupy a run of c consecutive sorted positions starting after ``a`` smaller
    items; their positions sum to ``c*a + c(c+1)/2``.  The window runs over distinct count values only.
    """
    g = list(group_cols)
    lists = ranked_lists(preds, ks, group_cols)
    counts = lists.groupBy(*g, "k", "item_id").agg(F.count(F.lit(1)).alias("x"))
    hist = counts.groupBy(*g, "k", "x").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*g, "k").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("a", F.coalesce(F.sum("c").over(w), F.lit(0)))
    tot = hist.groupBy(*g, "k").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("x")).alias("sx"),
        F.sum(F.col("x") * (2 * (F.col("c") * F.col("a") + F.col("c") * (F.col("c") + 1) / 2))).alias("s_pos"),
        F.sum(F.col("x") * F.col("c")).alias("s_cx"))
    # sum (2i - n - 1) x_i = 2 sum i x_i - (n + 1) sum x_i
    val = (F.col("s_pos") - (F.col("n") + 1) * F.col("s_cx")) / (F.col("n") * F.col("sx"))
    return tot.select(*g, "k", val.cast("double").alias("gini"))


def system_metrics(preds: DataFrame, train: DataFrame, test: DataFrame, ks: Sequence[int] = DEFAULT_KS,
                   relevant_threshold: int = 1, group_cols: Sequence[str] = ("model",),
                   stats: DataFrame | None = None) -> DataFrame:
    """Macro means over users plus Gini, one row per (group, k) (A10)."""
    g = list(group_cols)
    um = user_metrics(preds, train, test, ks, relevant_threshold, group_cols, stats)
    means = um.groupBy(*g, "k").agg(*[F.avg(m).alias(m) for m in USER_METRICS])
    return means.join(gini(preds, ks, group_cols), [*g, "k"])


def round_metrics(df: DataFrame, cols: Sequence[str], digits: int = DIGITS) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def wide_board(system: DataFrame, ks: Sequence[int] = DEFAULT_KS) -> DataFrame:
    """One row per model, ``<metric>_<k>`` columns (B18 tidy-up), sorted by model."""
    aggs = [F.max(F.when(F.col("k") == k, F.col(m))).alias(f"{m}_{k}") for k in ks for m in METRICS]
    return system.groupBy("model").agg(*aggs)


def leaderboard(preds: DataFrame, train: DataFrame, test: DataFrame, existing: DataFrame | None = None,
                ks: Sequence[int] = DEFAULT_KS, stats: DataFrame | None = None) -> DataFrame:
    """Evaluate models not yet on ``existing`` (J10), append (U4), sort by model."""
    todo = preds
    if existing is not None:
        todo = preds.join(existing.select("model").distinct(), "model", "left_anti")
    board = wide_board(system_metrics(todo, train, test, ks, stats=stats), ks)
    if existing is not None:
        board = existing.unionByName(board)
    return board.orderBy("model")


def read_board(spark, path: str) -> DataFrame:
    """The stored board, one row a model."""
    return spark.read.parquet(path)


def update_board(spark, path: str, preds: DataFrame, train: DataFrame, test: DataFrame, ks: Sequence[int] = DEFAULT_KS,
                 stats: DataFrame | None = None) -> int:
    """Evaluates the models that the board at ``path`` lacks and appends their rows (K9, S14, J10); returns how many.

    An absent board is an empty one.  A model's row is appended once, so a second run evaluates and changes nothing.
    """
    from kgrec.sources.files import exists
    names = preds.select("model").distinct()
    if exists(spark, path):
        names = names.join(read_board(spark, path).select("model"), "model", "left_anti")
    todo = [r["model"] for r in names.collect()]  # a row for each model
    if not todo:
        return 0
    board = wide_board(system_metrics(preds.filter(F.col("model").isin(todo)), train, test, ks, stats=stats), ks)
    board.write.mode("append").parquet(path)
    return len(todo)


def signed_ranks(per_user: DataFrame, metrics: Sequence[str] = tuple(USER_METRICS), digits: int = 6) -> DataFrame:
    """Wilcoxon signed-rank comparison of every two models on paired per-user metrics (the purpose of A9).

    ``per_user(model, k, user_id, <metrics>)``; a row for each ``(metric, k, a, b)``, a < b: users with both lists and a difference
    ``n``, the rank sum ``w_plus`` of those where a is better, and its normal deviate ``z`` with the correction for ties (null
    without a difference).  Differences are rounded to ``digits``; equal ones share the mean of their ranks.  Ranks come from the
    histogram of differences, so a task neither sorts nor holds the users of a pair; a user with models as lists, bounded by
    the number of models, gives its pairs.
    """
    from kgrec.operators.rank import running_sum
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    long = per_user.select("model", "k", "user_id", F.explode(values).alias("v")).select("model", "k", "user_id", "v.metric", "v.value")
    a = long.select("metric", "k", "user_id", F.col("model").alias("a"), F.col("value").alias("va"))
    b = long.select("metric", "k", "user_id", F.col("model").alias("b"), F.col("value").alias("vb"))
    keys = ["metric", "k", "a", "b"]
    pairs = a.join(b, ["metric", "k", "user_id"]).filter(F.col("a") < F.col("b")).withColumn("d", F.round(F.col("va") - F.col("vb"), digits))
    every = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_users"))
    cells = pairs.filter(F.col("d") != 0).groupBy(*keys, F.abs("d").alias("size")).agg(
        F.count(F.lit(1)).alias("c"), F.sum((F.col("d") > 0).cast("bigint")).alias("plus"))
    ranked = running_sum(cells, keys, [F.col("size")], "c", "before")
    rank, c = F.col("before") + (F.col("c") + 1) / 2.0, F.col("c").cast("double")
    sums = ranked.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("plus") * rank).alias("w_plus"), F.sum(c * c * c - c).alias("ties"))
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0)
    out = every.join(sums, keys, "left")
    return out.select(*keys, "n_users", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"),
                      F.when(spread > 0, (F.col("w_plus") - n * (n + 1) / 4.0) / spread).alias("z"))

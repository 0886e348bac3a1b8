"""Per-class quality metrics from (true, predicted) pairs.

Everything starts from ``groupBy(group, y, pred).count()`` — a partial
aggregation whose output is at most groups x K^2 rows — so predictions of any
size reduce to a tiny table before any metric is computed. One-vs-rest counts
are derived per class over the union of true and predicted labels.

Long output: ``(group..., metric, cls, score)`` with ``cls`` = class code as
text, or ``overall`` (support-weighted over the true classes).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultlens.operators.keys import join_same


def pair_counts(df: DataFrame, group: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    return df.groupBy(*group, y, pred).agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, group: Sequence[str] = ("node",), y: str = "y", pred: str = "pred") -> DataFrame:
    """One-vs-rest ``tp, fp, fn, tn`` per class over the union of labels."""
    g = list(group)
    if not g:
        return confusion(df.withColumn("_all", F.lit(0)), ["_all"], y, pred).drop("_all")
    pc = pair_counts(df, g, y, pred)
    contrib = F.when(F.col(y) == F.col(pred),
                     F.array(F.struct(F.col(y).alias("cls"), F.col("n").alias("tp"), F.lit(0).cast("long").alias("fp"),
                                      F.lit(0).cast("long").alias("fn"))))\
        .otherwise(F.array(
            F.struct(F.col(y).alias("cls"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"),
                     F.col("n").alias("fn")),
            F.struct(F.col(pred).alias("cls"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("fp"),
                     F.lit(0).cast("long").alias("fn"))))
    ex = pc.select(*g, F.explode(contrib).alias("c")).select(*g, "c.*")
    per = ex.groupBy(*g, "cls").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    tot = pc.groupBy(*g).agg(F.sum("n").alias("_total"))
    j = join_same(per, tot, g)
    return j.withColumn("tn", F.col("_total") - F.col("tp") - F.col("fp") - F.col("fn")).drop("_total")


def _ratio(num, den):
    return F.try_divide(num.cast("double"), den.cast("double"))


METRIC_EXPRS = {
    # A13 (zero_division handled separately), A16-A19
    "f1": lambda: _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
    "sensitivity": lambda: _ratio(F.col("tp"), F.col("tp") + F.col("fn")),
    "specificity": lambda: _ratio(F.col("tn"), F.col("tn") + F.col("fp")),
    "fp_rate": lambda: _ratio(F.col("fp"), F.col("fp") + F.col("tn")),
    "fn_rate": lambda: _ratio(F.col("fn"), F.col("fn") + F.col("tp")),
}


def class_scores(conf: DataFrame, group: Sequence[str], metrics: Sequence[str] = tuple(METRIC_EXPRS),
                 zero_division: float = 0.0, labels: Sequence[int] | None = None) -> DataFrame:
    """Per-class scores plus the ``overall`` row weighted by true support.

    F1 of a class without true or predicted rows is ``zero_division``; the other
    rates are NULL where undefined. ``labels`` fixes the class list of the
    per-class rows (absent classes then get their undefined value).
    """
    g = list(group)
    if not g:
        out = class_scores(conf.withColumn("_all", F.lit(0)), ["_all"], metrics, zero_division, labels)
        return out.drop("_all")
    c = conf
    if labels is not None:
        # the fixed label list, generated next to every group key
        full = conf.select(*g).distinct().select(*g, F.explode(F.array(*[F.lit(int(x)) for x in labels]))
                                                 .alias("cls"))
        # a class that never occurs has no positives: all rows of the group are true negatives
        rows_of = conf.groupBy(*g).agg(F.max(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("_rows"))
        c = join_same(join_same(full, conf, [*g, "cls"], "left"), rows_of, g).withColumn(
            "tn", F.coalesce("tn", "_rows")).drop("_rows").fillna(0, subset=["tp", "fp", "fn"])
    rows = []
    for m in metrics:
        e = METRIC_EXPRS[m]()
        if m == "f1":
            e = F.coalesce(e, F.lit(float(zero_division)))
        rows.append(F.struct(F.lit(m).alias("metric"), e.alias("score")))
    per = c.select(*g, "cls", (F.col("tp") + F.col("fn")).alias("support"), F.explode(F.array(*rows)).alias("m")) \
        .select(*g, "cls", "support", "m.metric", "m.score")
    overall = per.where(F.col("support") > 0).groupBy(*g, "metric").agg(
        _ratio(F.sum(F.col("score") * F.col("support")), F.sum("support")).alias("score"))
    if labels is not None:
        # overall always weights the full set of true classes, whatever ``labels`` is
        per_all = class_scores(conf, g, metrics, zero_division, None)
        overall = per_all.where(F.col("cls") == "overall").drop("cls")
    out = per.select(*g, "metric", F.col("cls").cast("string").alias("cls"), "score")
    return out.unionByName(overall.select(*g, "metric", F.lit("overall").alias("cls"), "score"))


def scores(df: DataFrame, group: Sequence[str] = ("node",), y: str = "y", pred: str = "pred",
           metrics: Sequence[str] = tuple(METRIC_EXPRS), zero_division: float = 0.0,
           labels: Sequence[int] | None = None) -> DataFrame:
    """A12 -> A13/A16-A19 in one call."""
    return class_scores(confusion(df, group, y, pred), group, metrics, zero_division, labels)


def class_accuracy(df: DataFrame, group: Sequence[str] = ("node",), y: str = "y", pred: str = "pred") -> DataFrame:
    """Share of correct predictions among the rows of each true class (= recall)."""
    return df.groupBy(*group, y).agg(F.avg(F.when(F.col(y) == F.col(pred), 1.0).otherwise(0.0))
                                     .alias("class_accuracy"))


def fold_means(fold_scores: DataFrame, group: Sequence[str], fold: str = "fold") -> DataFrame:
    """Mean over folds per (group, metric, cls); ``fold_scores`` carries a fold column."""
    return fold_scores.groupBy(*group, "metric", "cls").agg(F.avg("score").alias("score"),
                                                            F.count(fold).alias("n_folds"))


def fold_table(fold_scores: DataFrame, group: Sequence[str], fold: str = "fold") -> DataFrame:
    """A20 as the studied tables have it: a row per fold and the extra ``all`` row of means."""
    cols = [*group, "metric", "cls", "fold", "score"]
    each = fold_scores.select(*group, "metric", "cls", F.col(fold).cast("string").alias("fold"), "score")
    return each.unionByName(fold_means(fold_scores, group, fold).withColumn("fold", F.lit("all")).select(*cols))


def wide_scores(long_scores: DataFrame, group: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """Pivot a long score table to ``overall, <class>...`` columns (one row per group and metric)."""
    return long_scores.groupBy(*group, "metric").pivot("cls", ["overall", *classes]).agg(F.first("score"))




# X3 ------------------------------------------------------------------------------
def label_scorers(labels: Sequence[int], group: Sequence[str] = ("node",), metric: str = "f1", zero_division: float = 0.0):
    """A scorer per label and one for all of them: name -> function of a table of
    ``y, pred`` that gives ``(group..., score)``. Names are the labels as text and
    ``weighted`` (by true support, over all true classes). A label that a group
    never has scores its undefined value."""
    wanted = [str(x) for x in dict.fromkeys(labels)]

    def scorer(cls: str):
        def score(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
            found = scores(df, group, y, pred, [metric], zero_division, None if cls == "overall" else [int(cls)])
            return found.where(F.col("cls") == cls).select(*group, "score")
        return score

    return {**{name: scorer(name) for name in wanted}, "weighted": scorer("overall")}

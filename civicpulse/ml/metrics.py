"""Multi-label scores over 0/1 arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicpulse.session import via_table


def _ratio(top: Column, bottom: Column) -> Column:
    """A quotient that is 0 where it is undefined."""
    return F.when(bottom == 0, F.lit(0e0)).otherwise(top.cast("double") / bottom)


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _ratio(2 * tp, 2 * tp + fp + fn)


def label_confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``tp, fp, fn`` per label position, one row per label."""
    cell = F.posexplode(F.arrays_zip(F.col(truth).alias("t"), F.col(predicted).alias("p")))
    t, p = F.col("c.t") == 1, F.col("c.p") == 1
    return (
        df.select(cell.alias("label", "c"))
        .groupBy("label")
        .agg(
            F.count_if(t & p).alias("tp"),
            F.count_if(~t & p).alias("fp"),
            F.count_if(t & ~p).alias("fn"),
        )
    )


def f1_scores(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """``macro_f1, micro_f1, weighted_f1`` in one row."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    support = tp + fn
    return label_confusion(df, truth, predicted).agg(
        F.avg(_f1(tp, fp, fn)).alias("macro_f1"),
        _f1(F.sum(tp), F.sum(fp), F.sum(fn)).alias("micro_f1"),
        _ratio(F.sum(_f1(tp, fp, fn) * support), F.sum(support)).alias("weighted_f1"),
    )


def classification_report(
    df: DataFrame, classes: Sequence[str], truth: str = "truth", predicted: str = "predicted"
) -> DataFrame:
    """``label, precision, recall, f1, support`` per class, then four averages.

    One pass over the rows: each adds a cell per class and one, at position -1,
    with the scores of its own label set. The averages reuse the shuffled cells.
    """
    table = _report_cells(df, truth, predicted)
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    names = F.array(*[F.lit(c) for c in classes])
    precision, recall, f1 = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _f1(tp, fp, fn)
    support = tp + fn
    per_class = table.filter(F.col("label") >= 0)
    per_label = per_class.select(
        F.get(names, F.col("label")).alias("label"),
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
        support.alias("support"),
    )
    all_tp, all_fp, all_fn = F.sum(tp), F.sum(fp), F.sum(fn)
    total = F.sum(support)

    def weighted(score: Column) -> Column:
        return _ratio(F.sum(score * support), total)

    def row(name: str, p: Column, r: Column, f: Column) -> Column:
        return F.struct(
            F.lit(name).alias("label"),
            p.alias("precision"),
            r.alias("recall"),
            f.alias("f1"),
            total.alias("support"),
        )

    averages = per_class.agg(
        F.array(
            row(
                "micro avg",
                _ratio(all_tp, all_tp + all_fp),
                _ratio(all_tp, all_tp + all_fn),
                _f1(all_tp, all_fp, all_fn),
            ),
            row("macro avg", F.avg(precision), F.avg(recall), F.avg(f1)),
            row("weighted avg", weighted(precision), weighted(recall), weighted(f1)),
        ).alias("rows")
    ).select(F.inline("rows"))
    samples = table.filter(F.col("label") < 0).select(
        F.lit("samples avg").alias("label"), "precision", "recall", "f1", support.alias("support")
    )
    return per_label.unionByName(averages).unionByName(samples)


def _report_cells(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Summed cells per class, and the mean row scores at position -1."""

    def total(array: Column) -> Column:
        return F.aggregate(array, F.lit(0), lambda a, x: a + x)

    nothing = F.lit(None).cast("double")

    def cell(label: Column, tp: Column, fp: Column, fn: Column, *scores: Column) -> Column:
        p, r, f = scores or (nothing, nothing, nothing)
        return F.struct(
            label.alias("label"),
            tp.alias("tp"),
            fp.alias("fp"),
            fn.alias("fn"),
            p.alias("precision"),
            r.alias("recall"),
            f.alias("f1"),
        )

    rows = df.select(
        F.arrays_zip(F.col(truth).alias("t"), F.col(predicted).alias("p")).alias("pairs"),
        total(F.zip_with(truth, predicted, lambda t, p: t * p)).alias("tp"),
        total(F.col(truth)).alias("t"),
        total(F.col(predicted)).alias("p"),
    )
    classes = F.transform(
        "pairs",
        lambda c, i: cell(
            i, c["t"] * c["p"], (1 - c["t"]) * c["p"], c["t"] * (1 - c["p"])
        ),
    )
    tp, t, p = F.col("tp"), F.col("t"), F.col("p")
    whole = cell(
        F.lit(-1), tp, p - tp, t - tp, _ratio(tp, p), _ratio(tp, t), _ratio(2 * tp, t + p)
    )
    return (
        rows.select(F.inline(F.concat(classes, F.array(whole))))
        .groupBy("label")
        .agg(
            *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")],
            *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")],
        )
    )


def _score_cells(df: DataFrame, truth: str, scores: str) -> DataFrame:
    """``(label, score, t)``, one row per row and class; rows without a score are left out."""
    cell = F.posexplode(F.arrays_zip(F.col(truth).alias("t"), F.col(scores).alias("s")))
    return df.select(cell.alias("label", "c")).select("label", F.col("c.s").alias("score"), F.col("c.t").alias("t")).dropna()


def ranking_scores(
    df: DataFrame, truth: str = "truth", scores: str = "scores", slices: int = 64
) -> DataFrame:
    """``label, positives, negatives, auc``: how often a row of the class scores above another.

    Ties count half; the area is null where a class has only one side. Rows are first summed
    by score. Ranks come from two windows, over the sums of ``slices`` ranges of scores and
    over the scores inside one range, so no task sees all scores of a class.
    """
    pos, neg = F.col("pos"), F.col("neg")
    counts = via_table(
        _score_cells(df, truth, scores)
        .groupBy("label", "score")
        .agg(F.count_if(F.col("t") == 1).alias("pos"), F.count_if(F.col("t") != 1).alias("neg")),
        "scores",
    )
    # One row per class.
    bounds = counts.groupBy("label").agg(
        F.percentile_approx("score", [i / slices for i in range(1, slices)]).alias("bounds")
    )
    sliced = counts.join(F.broadcast(bounds), "label").select(
        "label", "score", "pos", "neg",
        F.size(F.filter("bounds", lambda b: b < F.col("score"))).alias("slice"),
    )
    earlier = Window.partitionBy("label").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    below = sliced.groupBy("label", "slice").agg(F.sum(neg).alias("n")).select(
        "label", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("below")
    )
    inside = Window.partitionBy("label", "slice").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sliced.withColumn("inside", F.coalesce(F.sum(neg).over(inside), F.lit(0)))
    won = pos * (F.col("below") + F.col("inside") + neg / F.lit(2.0))
    sides = F.sum(pos).cast("double") * F.sum(neg)
    return (
        ranked.join(F.broadcast(below), ["label", "slice"])  # ``slices`` rows a class
        .groupBy("label")
        .agg(
            F.sum(pos).alias("positives"), F.sum(neg).alias("negatives"),
            F.when(sides > 0, F.sum(won) / sides).alias("auc"),
        )
    )


def calibration(
    df: DataFrame, truth: str = "truth", probabilities: str = "probabilities", bins: int = 10
) -> DataFrame:
    """``label, bin, n, mean_probability, rate``: what was expected and what was seen."""
    place = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return (
        _score_cells(df, truth, probabilities)
        .groupBy("label", place.alias("bin"))
        .agg(F.count("*").alias("n"), F.avg("score").alias("mean_probability"), F.avg("t").alias("rate"))
    )

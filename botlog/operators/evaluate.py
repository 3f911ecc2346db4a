"""Evaluation of a detector against labels.

Every operator takes a DataFrame with ``y_true`` (0/1), ``y_pred`` (0/1)
and ``score`` (higher = more likely positive) so it applies to any model.
Counts are single grouped aggregates; ROC quantities use the bucketed
prefix sums of :mod:`botlog.operators.ranking` (exact; the only
unpartitioned window there runs over one total per bucket).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botlog.operators.ranking import exact_percentiles, percentiles_from_prefix, prefix_counts_with_totals


def confusion_matrix(ev: DataFrame) -> DataFrame:
    """One row: tn, fp, fn, tp (always all four cells)."""
    y, p = F.col("y_true"), F.col("y_pred")
    return ev.agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def _safe_div(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _prf(tp, fp, fn):
    prec = _safe_div(tp, tp + fp)
    rec = _safe_div(tp, tp + fn)
    f1 = _safe_div(2 * tp, 2 * tp + fp + fn)
    return prec, rec, f1


def classification_report(ev: DataFrame, names=("Likely Human", "Likely Bot")) -> DataFrame:
    """Per class precision / recall / f1 / support, accuracy, macro and
    support-weighted averages (zero division -> 0)."""
    cm = confusion_matrix(ev)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    p1, r1, f1 = _prf(tp, fp, fn)          # positive class
    p0, r0, f0 = _prf(tn, fn, fp)          # negative class
    s0, s1 = tn + fp, tp + fn
    total = (s0 + s1).cast("double")
    acc = _safe_div(tp + tn, s0 + s1)
    w0, w1 = _safe_div(s0, total), _safe_div(s1, total)
    row = F.struct
    rows = F.array(
        row(F.lit(names[0]).alias("label"), p0.alias("precision"), r0.alias("recall"), f0.alias("f1_score"), s0.alias("support")),
        row(F.lit(names[1]).alias("label"), p1.alias("precision"), r1.alias("recall"), f1.alias("f1_score"), s1.alias("support")),
        row(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
            F.lit(None).cast("double").alias("recall"), acc.alias("f1_score"), (s0 + s1).alias("support")),
        row(F.lit("macro avg").alias("label"), ((p0 + p1) / 2).alias("precision"), ((r0 + r1) / 2).alias("recall"),
            ((f0 + f1) / 2).alias("f1_score"), (s0 + s1).alias("support")),
        row(F.lit("weighted avg").alias("label"), (p0 * w0 + p1 * w1).alias("precision"),
            (r0 * w0 + r1 * w1).alias("recall"), (f0 * w0 + f1 * w1).alias("f1_score"), (s0 + s1).alias("support")),
    )
    return cm.select(F.inline(rows))


def precision_recall_f1_from_counts(tp, fp, fn):
    """(precision, recall, f1) column expressions from count columns (zero
    division -> 0)."""
    return _prf(tp, fp, fn)


def _score_table(ev: DataFrame, n_buckets=None) -> DataFrame:
    return _score_table_with_totals(ev, n_buckets)[0]


def _score_table_with_totals(ev: DataFrame, n_buckets=None, neighbours: bool = False):
    y = F.col("y_true")
    return prefix_counts_with_totals(ev, "score", {"pos": (y == 1).cast("long"), "neg": (y == 0).cast("long")},
                                     descending=True, n_buckets=n_buckets, neighbours=neighbours)


def roc_auc(ev: DataFrame, n_buckets=None) -> DataFrame:
    """One row ``auc``: area under the ROC curve of ``score`` (ties count
    half); null when only one class is present."""
    st, tot = _score_table_with_totals(ev, n_buckets)
    P, N = tot["pos"], tot["neg"]
    area = st.agg(F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0)).alias("area"))
    if P > 0 and N > 0:
        return area.select((F.col("area") / F.lit(float(P) * float(N))).alias("auc"))
    return area.select(F.lit(None).cast("double").alias("auc"))


def roc_auc_value(ev: DataFrame, n_buckets=None) -> float | None:
    return roc_auc(ev, n_buckets).first()["auc"]


def roc_curve(ev: DataFrame, n_buckets=None) -> DataFrame:
    """ROC points (fpr, tpr, threshold): the origin with threshold +inf, then
    one point per distinct score in descending order (rates null when a
    class is absent)."""
    return _curve_points(ev, *_score_table_with_totals(ev, n_buckets))


def roc_curve_corners(ev: DataFrame, n_buckets=None) -> DataFrame:
    """:func:`roc_curve` without the points on a straight stretch: a point goes
    when the step to the next lower score adds as many positives and negatives
    as the step to it (both second differences are zero). The first and the last
    point stay, and so does the area under the curve. With billions of distinct
    scores most rows go; each needs only its neighbour, which the pass over
    the ordered buckets carries along, over bucket borders too."""
    st, tot = _score_table_with_totals(ev, n_buckets, neighbours=True)
    first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
    turn = (F.col("pos") != F.col("below_pos")) | (F.col("neg") != F.col("below_neg"))
    return _curve_points(ev, st.filter(first | F.coalesce(turn, F.lit(True))), tot)


def _curve_points(ev: DataFrame, st: DataFrame, tot: dict) -> DataFrame:
    P, N = tot["pos"], tot["neg"]

    def rate(c, d):
        return (F.col(c) / F.lit(float(d))) if d else F.lit(None).cast("double")

    pts = st.select(rate("cum_neg", N).alias("fpr"), rate("cum_pos", P).alias("tpr"),
                    F.col("score").cast("double").alias("threshold"))
    origin = ev.sparkSession.range(1).select(
        (F.lit(0.0) if N else F.lit(None).cast("double")).alias("fpr"),
        (F.lit(0.0) if P else F.lit(None).cast("double")).alias("tpr"),
        F.lit(math.inf).alias("threshold"))
    return origin.unionByName(pts)


def label_balance(df: DataFrame, label: str = "ua_bot_flag") -> DataFrame:
    """(label, count) per class."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("count"))


def require_positive_labels(df: DataFrame, label: str = "ua_bot_flag") -> None:
    """Supervised training needs at least one positive label."""
    if df.filter(F.col(label) == 1).limit(1).count() == 0:
        raise ValueError(f"no positive {label} in the data: cannot train a supervised model")


# --- contamination levels ---------------------------------------------------
#
# An isolation forest fitted with the same seed and data gives the same trees
# at every contamination level; only the cut (the level-th percentile of the
# raw scores) moves. So the sweep fits once and evaluates every level in one
# aggregate; AUC does not depend on the cut.

def _cuts(df: DataFrame, score: str, levels, cut_digits):
    cuts = exact_percentiles(df, score, levels)
    if cut_digits is not None:
        cuts = [None if c is None else round(c, cut_digits) for c in cuts]
    return cuts


def contamination_cuts(df: DataFrame, score: str, levels, cut_digits: int | None = None) -> DataFrame:
    """(contamination, cut, flagged): the level-th percentile of ``score``
    (lower = more anomalous) and how many rows fall strictly below it."""
    cuts = _cuts(df, score, levels, cut_digits)
    s = F.col(score)
    counts = df.agg(*[F.count_if(s < F.lit(c)).alias(f"n{i}") for i, c in enumerate(cuts)])
    rows = F.array(*[F.struct(F.lit(float(lv)).alias("contamination"), F.lit(c).cast("double").alias("cut"),
                              F.col(f"n{i}").alias("flagged")) for i, (lv, c) in enumerate(zip(levels, cuts))])
    return counts.select(F.inline(rows))


def contamination_sweep(df: DataFrame, score: str, label: str, levels, cut_digits: int | None = None,
                        n_buckets=None) -> DataFrame:
    """(contamination, cut, precision, recall, f1, auc) per level; a row is
    predicted positive when ``score`` is strictly below the level's cut, and
    AUC ranks rows by ``-score``.

    Everything comes from one ascending distinct-score table with counts
    (rows, positives, negatives) and their prefix sums: the cuts are order
    statistics of it, and below a score s lie cum_pos(s) - pos(s) positives,
    which gives both the confusion counts at each cut and the AUC."""
    y = F.col(label)
    pc, tot = prefix_counts_with_totals(
        df, score, {"c": F.lit(1).cast("long"), "pos": (y == 1).cast("long"), "neg": (y == 0).cast("long")},
        n_buckets=n_buckets)
    cuts = percentiles_from_prefix(pc, score, tot["c"], levels)
    if cut_digits is not None:
        cuts = [None if c is None else round(c, cut_digits) for c in cuts]
    s, pos, neg = F.col(score), F.col("pos"), F.col("neg")
    P, N = tot["pos"], tot["neg"]
    aggs = [F.sum(neg * (F.col("cum_pos") - pos / 2.0)).alias("area")]
    for i, c in enumerate(cuts):
        below = s < F.lit(c)
        aggs += [F.coalesce(F.sum(F.when(below, pos)), F.lit(0)).alias(f"tp{i}"),
                 F.coalesce(F.sum(F.when(below, neg)), F.lit(0)).alias(f"fp{i}")]
    counts = pc.agg(*aggs)
    auc = (F.col("area") / F.lit(float(P) * float(N))) if P > 0 and N > 0 else F.lit(None).cast("double")
    rows = []
    for i, (lv, c) in enumerate(zip(levels, cuts)):
        tp, fp = F.col(f"tp{i}"), F.col(f"fp{i}")
        p, r, f = _prf(tp, fp, F.lit(P) - tp)
        rows.append(F.struct(F.lit(float(lv)).alias("contamination"), F.lit(c).cast("double").alias("cut"),
                             p.alias("precision"), r.alias("recall"), f.alias("f1"), auc.alias("auc")))
    return counts.select(F.inline(F.array(*rows)))


def best_contamination(sweep: DataFrame) -> DataFrame:
    """The level with the highest F1 (the lowest level among ties)."""
    return sweep.orderBy(F.col("f1").desc(), F.col("contamination").asc()).limit(1)

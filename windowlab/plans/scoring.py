"""Queries: thresholds, confusion, ROC and interval measures on the score table."""

from __future__ import annotations

from pyspark.sql import functions as F

from windowlab.fixtures import importances, scores, seed_results, sql_with, wide
from windowlab.operators import joins, metrics
from windowlab.plans.registry import query
from windowlab.session import fresh_path
from windowlab.sources import sinks

KEYS = ["domain", "model"]


def threshold_sql(source="scores", keys="domain, model", lo=10, hi=90, score="score"):
    """Brute force over the grid: all thresholds, lowest of the best."""
    return (f"SELECT {keys}, t, acc FROM (SELECT {keys}, t, acc, row_number() OVER (PARTITION BY {keys} ORDER BY acc DESC, t) AS rn FROM "
            f"(SELECT {keys}, t, sum(CASE WHEN ({score} >= t/100.0::DOUBLE) = (y=1) THEN c ELSE 0 END)::DOUBLE/sum(c) AS acc FROM "
            f"(SELECT {keys}, {score}, y, count(*) AS c FROM {source} GROUP BY {keys}, {score}, y), "
            f"(SELECT CAST(range AS INTEGER) AS t FROM range({lo},{hi + 1})) GROUP BY {keys}, t)) WHERE rn=1")


@query("best_threshold", "M1 J8", sql_with("scores", b=threshold_sql()) + "SELECT domain, model, t, round(acc,6) AS t_acc FROM b")
def best_threshold(spark, sf):
    return metrics.best_threshold(scores(spark, sf), KEYS, "y", "score").withColumn("t_acc", F.round("t_acc", 6))


@query("best_threshold_short_grid", "M2", sql_with("scores", b=threshold_sql(hi=89)) + "SELECT domain, model, t, round(acc,6) AS t_acc FROM b")
def best_threshold_short_grid(spark, sf):
    return metrics.best_threshold(scores(spark, sf), KEYS, "y", "score", grid=(10, 89)).withColumn("t_acc", F.round("t_acc", 6))


_UNB = "SELECT domain, label AS y, qty*3 + price/100 + disc AS s FROM wide"


@query(
    "best_quantile_threshold", "M3",
    sql_with("wide", u=_UNB,
             q="SELECT domain, unnest(quantile_cont(s, list_transform(range(81), lambda i: 0.05::DOUBLE + 0.9::DOUBLE*i/80))) AS t FROM u GROUP BY domain",
             a="""SELECT q.domain, t, sum(CASE WHEN (s >= t) = (y=1) THEN 1 ELSE 0 END)::DOUBLE/count(*) AS acc
               FROM q JOIN u USING (domain) GROUP BY q.domain, t""",
             r="SELECT *, row_number() OVER (PARTITION BY domain ORDER BY acc DESC, t) AS rn FROM a")
    + "SELECT domain, round(t,5) AS t, round(acc,6) AS t_acc FROM r WHERE rn=1",
)
def best_quantile_threshold(spark, sf):
    w = wide(spark, sf).select("domain", F.col("label").alias("y"), (F.col("qty") * 3 + F.col("price") / 100 + F.col("disc")).alias("s"))
    b = metrics.best_quantile_threshold(w, ["domain"], "y", "s")
    return b.select("domain", F.round("t", 5).alias("t"), F.round("t_acc", 6).alias("t_acc"))


CM_SQL = dict(
    b=threshold_sql(),
    c="""SELECT s.domain, s.model, count(*) FILTER (y=0 AND score < t/100.0::DOUBLE) AS tn, count(*) FILTER (y=0 AND score >= t/100.0::DOUBLE) AS fp,
      count(*) FILTER (y=1 AND score < t/100.0::DOUBLE) AS fn, count(*) FILTER (y=1 AND score >= t/100.0::DOUBLE) AS tp
      FROM scores s JOIN b USING (domain, model) GROUP BY s.domain, s.model""",
)


def thresholded(spark, sf):
    """Scores with the best threshold of their (domain, model): one row per key is joined."""
    s = scores(spark, sf)
    return s.join(F.broadcast(metrics.best_threshold(s, KEYS, "y", "score")), KEYS)


def predicted():
    return (F.col("score") >= F.col("t") / 100.0).cast("int")


@query("confusion_counts", "M4", sql_with("scores", **CM_SQL) + "SELECT domain, model, tn, fp, fn, tp, round((tp+tn)::DOUBLE/(tn+fp+fn+tp),6) AS accuracy FROM c")
def confusion_counts(spark, sf):
    return metrics.confusion(thresholded(spark, sf), KEYS, "y", predicted()).withColumn("accuracy", F.round("accuracy", 6))


MEASURE_SQL = """SELECT domain, model, round(tp::DOUBLE/(tp+fp),6) AS precision, round(tp::DOUBLE/(tp+fn),6) AS recall,
  round(2.0::DOUBLE*tp/(2*tp+fp+fn),6) AS f1,
  round((tp::DOUBLE*tn-fp::DOUBLE*fn)/sqrt((tp+fp)::DOUBLE*(tp+fn)*(tn+fp)*(tn+fn)),6) AS mcc,
  round(((tp+tn)::DOUBLE/n - e)/(1-e),6) AS kappa FROM (SELECT *, (tn+fp+fn+tp)::DOUBLE AS n,
  ((tp+fp)::DOUBLE*(tp+fn)+(tn+fn)::DOUBLE*(tn+fp))/((tn+fp+fn+tp)::DOUBLE*(tn+fp+fn+tp)) AS e FROM c)"""


@query("classification_measures", "M7", sql_with("scores", **CM_SQL) + MEASURE_SQL)
def classification_measures(spark, sf):
    m = metrics.measures(metrics.confusion(thresholded(spark, sf), KEYS, "y", predicted()))
    return m.select(*KEYS, *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "mcc", "kappa")])


@query(
    "accuracy_intervals", "M8 M9",
    sql_with("scores", **CM_SQL, p="SELECT domain, model, (tn+fp+fn+tp)::DOUBLE AS n, (tp+tn)::DOUBLE/(tn+fp+fn+tp) AS p FROM c")
    + """SELECT domain, model,
      round(greatest(0, (p+1.96::DOUBLE*1.96::DOUBLE/(2*n) - 1.96::DOUBLE*sqrt(p*(1-p)/n+1.96::DOUBLE*1.96::DOUBLE/(4*n*n)))/(1+1.96::DOUBLE*1.96::DOUBLE/n)),6) AS wilson_lo,
      round(least(1, (p+1.96::DOUBLE*1.96::DOUBLE/(2*n) + 1.96::DOUBLE*sqrt(p*(1-p)/n+1.96::DOUBLE*1.96::DOUBLE/(4*n*n)))/(1+1.96::DOUBLE*1.96::DOUBLE/n)),6) AS wilson_hi,
      round(greatest(0, p-1.96::DOUBLE*sqrt(p*(1-p)/n)),6) AS wald_lo, round(least(1, p+1.96::DOUBLE*sqrt(p*(1-p)/n)),6) AS wald_hi FROM p""",
)
def accuracy_intervals(spark, sf):
    c = metrics.confusion(thresholded(spark, sf), KEYS, "y", predicted()).withColumn("n", F.expr("tn + fp + fn + tp"))
    return metrics.with_intervals(c).select(*KEYS, *[F.round(x, 6).alias(x) for x in ("wilson_lo", "wilson_hi", "wald_lo", "wald_hi")])


AUC_SQL = dict(
    sc="SELECT domain, model, score, sum(y)::DOUBLE AS p, sum(1-y)::DOUBLE AS q FROM scores GROUP BY 1,2,3",
    sp="""SELECT *, coalesce(sum(q) OVER (PARTITION BY domain, model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS qb,
       coalesce(sum(p) OVER (PARTITION BY domain, model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS pb,
       sum(p) OVER (PARTITION BY domain, model) AS pt, sum(q) OVER (PARTITION BY domain, model) AS qt FROM sc""",
    au="SELECT domain, model, sum(p*(qb+q/2))/(max(pt)*max(qt)) AS auc FROM sp GROUP BY 1, 2",
)


@query("roc_auc", "M5", sql_with("scores", **AUC_SQL) + "SELECT domain, model, round(auc,8) AS auc FROM au")
def roc_auc(spark, sf):
    return metrics.roc_auc(scores(spark, sf), KEYS, "y", "score").withColumn("auc", F.round("auc", 8))


@query("roc_curve_points", "M6", sql_with("scores", **AUC_SQL) + "SELECT domain, model, score, round((qt-qb)/qt,6) AS fpr, round((pt-pb)/pt,6) AS tpr FROM sp")
def roc_curve_points(spark, sf):
    return metrics.roc_curve(scores(spark, sf), KEYS, "y", "score").select(*KEYS, "score", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(
    "constant_score_auc", "M7 M10",
    sql_with("wide") + "SELECT domain, 0.5::DOUBLE AS auc, 'hard' AS score_type FROM wide GROUP BY domain",
)
def constant_score_auc(spark, sf):
    """A model that gives no probabilities is ranked by a constant and gets .5."""
    w = wide(spark, sf).select("domain", F.col("label").alias("y"), F.lit(0.5).alias("score"))
    return metrics.roc_auc(w, ["domain"], "y", "score").withColumn("score_type", F.lit(metrics.score_type(w.columns)))


@query(
    "leaderboard", "M11",
    sql_with("scores", **CM_SQL, l="SELECT domain || '/' || model AS name, round((tp+tn)::DOUBLE/(tn+fp+fn+tp),6) AS accuracy FROM c")
    + "SELECT name, accuracy FROM l ORDER BY accuracy DESC, name LIMIT 3",
)
def leaderboard(spark, sf):
    c = metrics.confusion(thresholded(spark, sf), KEYS, "y", predicted())
    c = c.select(F.concat_ws("/", "domain", "model").alias("name"), F.round("accuracy", 6).alias("accuracy"))
    return metrics.leaderboard(c, "accuracy", "name", 3)


@query(
    "rescaled_confusion", "M13 M14",
    sql_with("scores", b=threshold_sql(),
             k="""SELECT s.domain, s.model, s.run_id % 5 AS seed, CASE WHEN y=0 AND score<t/100.0::DOUBLE THEN 'tn' WHEN y=0 THEN 'fp' WHEN score<t/100.0::DOUBLE THEN 'fn' ELSE 'tp' END AS cell
               FROM scores s JOIN b USING (domain, model)""",
             g="SELECT domain, model, seed, cell, count(*) AS c FROM k GROUP BY 1,2,3,4",
             m="SELECT domain, model, cell, avg(c) AS mean FROM g GROUP BY 1,2,3",
             sc="SELECT *, mean*40000/sum(mean) OVER (PARTITION BY domain, model) AS s FROM m",
             f="SELECT *, floor(s) AS fl, round(s-floor(s),9) AS rem FROM sc",
             o="""SELECT *, row_number() OVER (PARTITION BY domain, model ORDER BY rem DESC, cell) AS rn, 40000 - sum(fl) OVER (PARTITION BY domain, model) AS deficit FROM f""")
    + """SELECT domain, model, cell, CAST(fl + CASE WHEN rn<=deficit THEN 1 ELSE 0 END AS BIGINT) AS n,
      round(100*(fl + CASE WHEN rn<=deficit THEN 1 ELSE 0 END)/40000,6) AS pct FROM o""",
)
def rescaled_confusion(spark, sf):
    cell = F.when((F.col("y") == 0) & (predicted() == 0), "tn").when(F.col("y") == 0, "fp").when(predicted() == 0, "fn").otherwise("tp")
    cells = thresholded(spark, sf).groupBy(*KEYS, F.pmod("run_id", F.lit(5)).alias("seed"), cell.alias("cell")).agg(F.count(F.lit(1)).alias("c"))
    return metrics.rescaled_confusion(cells, KEYS, "cell", "c", 40000).withColumn("pct", F.round("pct", 6))


@query(
    "score_histogram", "M16",
    sql_with("scores", h="SELECT domain, model, least(CAST(floor((score-0)/0.025::DOUBLE) AS INTEGER),39) AS bin, count(*) AS n FROM scores WHERE score BETWEEN 0 AND 1 GROUP BY 1,2,3")
    + "SELECT domain, model, bin, n, round((n/(sum(n) OVER (PARTITION BY domain, model)*0.025::DOUBLE))::DOUBLE,6) AS density FROM h",
)
def score_histogram(spark, sf):
    return metrics.histogram(scores(spark, sf), KEYS, "score", 0.0, 1.0, 40).withColumn("density", F.round("density", 6))


@query("score_cache", "K3 D8", sql_with("scores") + "SELECT domain, model, count(*) AS n, sum(y)::BIGINT AS pos, round(sum(score),3) AS s FROM scores WHERE model='by_qty' GROUP BY 1,2")
def score_cache(spark, sf):
    path = fresh_path(spark, "scores")
    sinks.write_scores(scores(spark, sf), path)
    s = spark.read.parquet(path).where("model = 'by_qty'")  # read prunes to one model's folders
    return s.groupBy("domain", "model").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"), F.round(F.sum("score"), 3).alias("s"))


@query(
    "models_side_by_side", "J9",
    sql_with("scores", **AUC_SQL) + """SELECT model, round(max(auc) FILTER (domain='static'),6) AS static_auc, round(max(auc) FILTER (domain='mobile'),6) AS mobile_auc FROM au GROUP BY model""",
)
def models_side_by_side(spark, sf):
    a = metrics.roc_auc(scores(spark, sf), KEYS, "y", "score").withColumn("auc", F.round("auc", 6))
    return joins.side_by_side(a, "model", "domain", ["auc"])


@query(
    "soft_vote", "T12",
    sql_with("scores") + "SELECT row_key, domain, round(avg(score),6) AS vote, max(y) AS y FROM scores GROUP BY 1, 2",
)
def soft_vote(spark, sf):
    from windowlab.operators import models
    return models.soft_vote(scores(spark, sf), ["row_key", "domain"], "score", "y", "model").withColumn("vote", F.round("vote", 6))

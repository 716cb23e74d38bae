"""Queries: training, search, calibration, ensembles, augmentation and composed experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from windowlab.fixtures import sql_with, wide
from windowlab.functions.hashing import sql_order_key, sql_uniform
from windowlab.operators import augment, joins, metrics, models, resample, scaling, selection, splits, stats, transfer
from windowlab.plans.inference import rounded
from windowlab.plans.registry import query
from windowlab.plans.splitting import SPLIT_SQL, run_rank_sql
from windowlab.session import stored
from windowlab.sources import scans

FEATURES = ["qty", "disc", "tax", "size", "price"]
IDS = ["domain", "run_id", "row_key"]


def prepared(spark, sf, seed=42, source="static", features=FEATURES):
    """Source split by run, scaled on its training part, with the whole target scaled the same way; written once."""
    w = wide(spark, sf)
    src = splits.split_windows(w.where(F.col("domain") == source), ["domain"], "run_id", [seed])
    src = src.select(*IDS, "label", "part", *features)
    tgt = w.where(F.col("domain") != source).select(*IDS, "label", F.lit("target").alias("part"), *features)
    params = scaling.fit_standard(src.where("part = 'train'"), [], features)
    return stored(scaling.apply_scaler(src.unionByName(tgt), params, [], features), "prepared")


def cell(data, estimator, features=FEATURES):
    """One transfer cell: fit on train, threshold on val, accuracy and AUC on source test and whole target."""
    d = models.assemble(data, features)
    fitted = estimator.fit(d.where("part = 'train'"))
    s = models.scored(fitted, d.where("part <> 'train'"), ["part", "row_key", F.col("label").cast("int").alias("y")])
    return judged(s)


def judged(s):
    s = stored(s, "scored")
    t = metrics.best_threshold(s.where("part = 'val'"), [], "y", "score")
    rest = s.where("part <> 'val'")
    cm = metrics.confusion(rest.join(F.broadcast(t.select("t"))), ["part", "t"], "y", (F.col("score") >= F.col("t") / 100.0).cast("int"))  # t is one row
    return cm.join(metrics.roc_auc(rest, ["part"], "y", "score"), "part").select("part", "t", "accuracy", "auc", "tn", "fp", "fn", "tp")


def show(df):
    return rounded(df, ["accuracy", "auc"])


@query("transfer_cell_logistic", "C1 T1")
def transfer_cell_logistic(spark, sf):
    d = prepared(spark, sf)
    return show(cell(d, models.logistic(1.0, d.where("part = 'train'").count())))


@query("transfer_cell_forest", "C1 T3")
def transfer_cell_forest(spark, sf):
    return show(cell(prepared(spark, sf), models.random_forest(10, 5)))


@query("transfer_cell_extra_trees", "T4")
def transfer_cell_extra_trees(spark, sf):
    return show(cell(prepared(spark, sf), models.extra_trees(10, 5)))


@query("transfer_cell_boosted", "C1 T5")
def transfer_cell_boosted(spark, sf):
    tuned = models.mapped_params({"iterations": 8, "depth": 3, "learning_rate": 0.3, "l2_leaf_reg": 3}, "gbt", ["l2_leaf_reg"])
    return show(cell(prepared(spark, sf), models.boosted().setParams(**tuned)))


@query("transfer_cell_bagged", "T7")
def transfer_cell_bagged(spark, sf):
    return show(cell(prepared(spark, sf), models.bagged_trees(8, 6)))


@query("bagged_forests", "T7")
def bagged_forests(spark, sf):
    d = models.assemble(prepared(spark, sf), FEATURES)
    fits = models.fit_bagged_forests(d.where("part = 'train'"), 2, 4, 5, 0.8)
    return show(judged(models.mean_probability(fits, d.where("part <> 'train'"), ["part", "row_key", F.col("label").cast("int").alias("y")])))


def decision_cell(s):
    """Unbounded scores get their threshold from quantiles of the validation scores."""
    s = stored(s, "scored")
    t = metrics.best_quantile_threshold(s.where("part = 'val'"), [], "y", "score").select("t")
    rest = s.where("part <> 'val'")
    cm = metrics.confusion(rest.join(F.broadcast(t)), ["part"], "y", (F.col("score") >= F.col("t")).cast("int"))
    return show(cm.join(metrics.roc_auc(rest, ["part"], "y", "score"), "part").select("part", "accuracy", "auc"))


@query("margin_classifier", "T8 M3 M10")
def margin_classifier(spark, sf):
    d = models.assemble(prepared(spark, sf), FEATURES)
    m = models.margin(1.0, d.where("part = 'train'").count(), 20).fit(d.where("part = 'train'"))
    return decision_cell(models.scored(m, d.where("part <> 'train'"), ["part", "row_key", F.col("label").cast("int").alias("y")]))


@query("kernel_margin", "T8")
def kernel_margin(spark, sf):
    """Gaussian-kernel margin through random Fourier columns."""
    rff = models.random_fourier(FEATURES, 0.2, 24)
    d = models.assemble(prepared(spark, sf).withColumns(rff), list(rff))
    m = models.margin(10.0, d.where("part = 'train'").count(), 20).fit(d.where("part = 'train'"))
    return decision_cell(models.scored(m, d.where("part <> 'train'"), ["part", "row_key", F.col("label").cast("int").alias("y")]))


@query("adaboost", "T6")
def adaboost(spark, sf):
    d = models.assemble(prepared(spark, sf), FEATURES)
    e = models.fit_adaboost(d.where("part = 'train'"), 5, depth=2)
    return decision_cell(models.adaboost_scored(e, d.where("part <> 'train'"), ["part", "row_key", F.col("label").cast("int").alias("y")]))


# Normal equations of the two-feature ridge, for the oracle.
RIDGE_SQL = dict(
    tr="SELECT qty AS x1, disc AS x2, 2.0::DOUBLE*label-1 AS t FROM wide WHERE domain='static'",
    mo="SELECT count(*)::DOUBLE AS n, avg(x1) AS m1, avg(x2) AS m2, avg(t) AS mt FROM tr",
    ss="""SELECT max(n) AS n, max(m1) AS m1, max(m2) AS m2, max(mt) AS mt, sum((x1-m1)*(x1-m1))+10 AS a, sum((x2-m2)*(x2-m2))+10 AS b, sum((x1-m1)*(x2-m2)) AS c,
        sum((x1-m1)*(t-mt)) AS p, sum((x2-m2)*(t-mt)) AS q FROM tr, mo""",
    co="SELECT (b*p-c*q)/(a*b-c*c) AS w1, (a*q-c*p)/(a*b-c*c) AS w2, m1, m2, mt FROM ss",
)


@query(
    "ridge_classifier", "T2",
    sql_with("wide", **RIDGE_SQL) + "SELECT row_key, round(mt + w1*(qty-m1) + w2*(disc-m2),5) AS score FROM wide, co WHERE domain='mobile'",
)
def ridge_classifier(spark, sf):
    d = models.assemble(wide(spark, sf), ["qty", "disc"])
    src = d.where("domain = 'static'")
    m = models.fit_ridge(src, 10.0, src.count())
    return rounded(models.ridge_scored(m, d.where("domain = 'mobile'"), ["row_key"]).select("row_key", "score"), ["score"], 5)


@query(
    "isotonic_curve", "T9",
    sql_with("wide", c="SELECT round(qty/50,4) AS s, sum(label)::DOUBLE AS p, count(*)::DOUBLE AS w FROM wide GROUP BY 1",
             r="SELECT *, row_number() OVER (ORDER BY s) AS i, sum(p) OVER (ORDER BY s) AS cp, sum(w) OVER (ORDER BY s) AS cw FROM c",
             jk="SELECT a.i AS j, b.i AS k, (b.cp-a.cp+a.p)/(b.cw-a.cw+a.w) AS v FROM r a JOIN r b ON a.i<=b.i",
             mn="SELECT i.i, j, min(v) AS v FROM r i JOIN jk ON j<=i.i AND k>=i.i GROUP BY 1, 2")
    + "SELECT s AS score, round(max(v),6) AS calibrated FROM mn JOIN r USING (i) GROUP BY 1",
)
def isotonic_curve(spark, sf):
    """Isotonic calibration of a score; the oracle is the max-min formula over the distinct scores."""
    s = wide(spark, sf).select(F.round(F.col("qty") / 50, 4).alias("score"), F.col("label").alias("y"))
    m = models.fit_isotonic(s, "score", "y")
    return rounded(models.isotonic_scored(m, s.select("score").distinct(), "score"), ["calibrated"])


@query("calibrated_model", "T9")
def calibrated_model(spark, sf):
    d = models.assemble(prepared(spark, sf), FEATURES)
    val, test = d.where("part = 'val'"), d.where("part IN ('test', 'target')")

    def fit_score(train):
        m = models.logistic(1.0, train.count()).fit(train)
        return lambda x: m.transform(x).withColumn("score", models.vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")

    out = models.calibrate(val, test, fit_score, "label", ["label"], "row_key", folds=3)
    return rounded(out.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.avg("calibrated").alias("mean_p"), F.avg("label").alias("rate"),
                                           F.avg(F.pow(F.col("calibrated") - F.col("label"), 2)).alias("brier")), ["mean_p", "rate", "brier"])


@query("stacked_ensemble", "T11")
def stacked_ensemble(spark, sf):
    d = models.assemble(prepared(spark, sf), FEATURES)
    train = d.where("part = 'train'")
    folds = splits.grouped_folds(train, ["domain"], "run_id").select("run_id", "fold")
    train = stored(train.join(folds, "run_id"), "train")
    bases = {"lr": models.logistic(1.0, train.count()), "rf": models.random_forest(5, 4), "et": models.extra_trees(5, 4)}
    out, _ = models.stack(train, d.where("part <> 'train'"), bases, "fold", ["part", "row_key"])
    return show(judged(out.select("part", "row_key", F.col("label").cast("int").alias("y"), "score")))


@query("grid_search", "T13 D11 S7 K4")
def grid_search(spark, sf):
    """Cross-validated search, its log as nested JSON text, read back and flattened to a row per model."""
    from windowlab.sources import sinks

    d = models.assemble(prepared(spark, sf), FEATURES).where("part = 'train'")
    d = stored(splits.stratified_folds(d, ["label"], "row_key", 42), "folds")
    log = {}
    for name, est, space, limit in (
        ("logisticregression", models.logistic(1.0, d.count(), 20), {"regParam": [0.0001, 0.01, 1.0]}, None),
        ("randomforest", models.random_forest(4, 3), {"maxDepth": [2, 4], "numTrees": [3, 6]}, 3),
    ):
        _, tried = models.search(d, est, space, "fold", limit)
        best, acc = max(tried, key=lambda x: x[1])
        log[name] = dict(cv_accuracy=acc, best_params={k: str(v) for k, v in best.items()}, elapsed_s=0.0, grid_mode="narrow", edge_params=[],
                         all_candidates=[dict(params={k: str(v) for k, v in p.items()}, mean_cv=a) for p, a in tried])
    import json

    n = d.agg(F.count(F.lit(1)).alias("n_train_pre_smote"))
    text = n.select("n_train_pre_smote", F.lit(json.dumps({"feature_names": FEATURES, "search_results": log})).alias("text"))
    parsed = scans.parse_search_log(text, "text", []).select("feature_names", "search_results")
    flat = sinks.flatten_search(parsed, [])
    return flat.select("model", F.round("cv_accuracy", 6).alias("cv_accuracy"), "best_params", "grid_mode")


@query("forest_importance", "N11 N13 X15")
def forest_importance(spark, sf):
    """Impurity importance of two forests per domain, normalised, and the share of it that features failing the variance ratio hold."""
    # written once: every pass of a fit would join again and gather the joined parts on the driver
    w, out = stored(wide(spark, sf).select("domain", "run_id", "label", *FEATURES), "windows"), None
    for d in ("static", "mobile"):
        x = models.assemble(w.where(F.col("domain") == d), FEATURES)
        for name, est in (("rf", models.random_forest(6, 4)), ("et", models.extra_trees(6, 4))):
            i = models.importances(est.fit(x), FEATURES, spark).select(F.lit(name).alias("method"), F.lit(d).alias("domain"), "feature", "importance")
            out = i if out is None else out.unionByName(i)
    out = selection.normalise_importance(out, ["method", "domain"])
    ratio = stats.variance_ratio(w, ["domain"], "run_id", FEATURES).select("domain", "feature", "passes")
    share = stats.failing_share(out, ratio, ["method", "domain"])
    return rounded(out.join(ratio, ["domain", "feature"]).join(share, ["method", "domain"]), ["importance", "failing_share"])


@query("permutation_importance", "N14 P13")
def permutation_importance(spark, sf):
    """Accuracy lost on a held-out fifth when one column is shuffled, mean over repeats, clipped and normalised."""
    w = wide(spark, sf).where("domain = 'static'")
    part = splits.stratified_split(w, ["label"], "row_key", 42, test=0.2, val=0)
    train = models.assemble(part.where("part = 'train'"), FEATURES)
    m = models.logistic(1.0, train.count()).fit(train)
    test = stored(part.where("part = 'test'").select("row_key", "label", *FEATURES), "test")
    right = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    base = m.transform(models.assemble(test, FEATURES)).agg(right.alias("base"))
    out = None
    for f in FEATURES:
        for r in range(2):
            s = resample.permute_column(test, "row_key", f, r, "_s").withColumn(f, F.col("_s"))
            a = m.transform(models.assemble(s, FEATURES)).agg(right.alias("acc")).select(F.lit(f).alias("feature"), "acc")
            out = a if out is None else out.unionByName(a)
    loss = out.join(F.broadcast(base)).groupBy("feature").agg(F.avg(F.col("base") - F.col("acc")).alias("importance"))  # base is one row
    return rounded(selection.normalise_importance(loss, []), ["importance"])


@query("seed_averaged_ranking", "N15")
def seed_averaged_ranking(spark, sf):
    """Importance averaged over seeds, each on its own grouped training part."""
    w, out = wide(spark, sf), None
    parts = stored(splits.split_windows(w, ["domain"], "run_id", [42, 43]).where("part = 'train'").select("domain", "seed", "label", *FEATURES), "train")
    for d in ("static", "mobile"):
        for s in (42, 43):
            x = models.assemble(parts.where((F.col("domain") == d) & (F.col("seed") == s)), FEATURES)
            i = models.importances(models.boosted(5, 3).fit(x), FEATURES, spark).withColumns({"domain": F.lit(d), "seed": F.lit(s)})
            out = i if out is None else out.unionByName(i)
    return rounded(selection.importance_ranking(out, ["domain"]), ["mean_importance"])


# ---- augmentation -----------------------------------------------------------------------------

SM_FEATURES = ["qty", "size", "price"]
SMOTE_SQL = dict(
    n="SELECT count(*) FILTER (label=1) AS n1, count(*) FILTER (label=0) AS n0 FROM wide",
    mr="SELECT row_key, qty, size, price FROM wide WHERE label = (SELECT CASE WHEN n1<=n0 THEN 1 ELSE 0 END FROM n)",
    po="SELECT qty, size, price, count(*) AS c, min(row_key) AS vkey FROM mr GROUP BY 1,2,3",
    rk=f"SELECT *, row_number() OVER (ORDER BY {sql_order_key('smote42', 'row_key')}, row_key) AS rn FROM mr",
    dr=f"""SELECT range AS draw, CAST(floor({sql_uniform(sql_order_key('base42', 'range'))} * (SELECT count(*) FROM mr)) + 1 AS BIGINT) AS rn,
         {sql_uniform(sql_order_key('pick42', 'range'))} AS pick, {sql_uniform(sql_order_key('gap42', 'range'))} AS u FROM range((SELECT abs(n1-n0) FROM n))""",
    dw="SELECT draw, pick, u, rk.qty, rk.size, rk.price FROM dr JOIN rk USING (rn)",
    qd="SELECT DISTINCT qty, size, price FROM dw",
    pr="""SELECT q.qty AS a, q.size AS b, q.price AS c, min({'d': (q.qty-p.qty)*(q.qty-p.qty)+(q.size-p.size)*(q.size-p.size)+(q.price-p.price)*(q.price-p.price),
         'k': p.vkey, 'm': p.c, 'x': p.qty, 'y': p.size, 'z': p.price}, 6) AS l FROM qd q, po p GROUP BY 1,2,3""",
    un="SELECT a, b, c, unnest(l) AS e, generate_subscripts(l, 1) AS i FROM pr",
    cu="SELECT *, e.m - CASE WHEN e.d=0 THEN 1 ELSE 0 END AS cc, sum(e.m - CASE WHEN e.d=0 THEN 1 ELSE 0 END) OVER (PARTITION BY a,b,c ORDER BY i) AS upto FROM un",
    sz="SELECT a, b, c, least(5, max(upto)) AS k FROM cu GROUP BY 1,2,3",
    ch="SELECT dw.*, CAST(floor(pick*k)+1 AS BIGINT) AS j FROM dw JOIN sz ON qty=a AND size=b AND price=c",
    ou="""SELECT draw, qty + u*(e.x-qty) AS qty, size + u*(e.y-size) AS size, price + u*(e.z-price) AS price FROM ch JOIN cu ON qty=a AND size=b AND price=c
        AND j <= upto AND j > upto - cc""",
)


@query(
    "smote_interpolation", "A1",
    sql_with("wide", **SMOTE_SQL) + "SELECT draw, round(qty,5) AS qty, round(size,5) AS size, round(price,5) AS price FROM ou",
)
def smote_interpolation(spark, sf):
    """Synthetic minority rows; the oracle searches all minority vectors for every base row."""
    w = wide(spark, sf)
    minor, n_min, n_maj, _ = augment.class_sizes(w, "label")
    rows = w.where(F.col("label") == minor)
    out = augment.interpolate(rows, rows, SM_FEATURES, "row_key", n_maj - n_min, 5, 42)
    return rounded(out, SM_FEATURES, 5)


@query(
    "smote_class_counts", "A1 A2",
    sql_with("wide", n="SELECT greatest(count(*) FILTER (label=1), count(*) FILTER (label=0)) AS m FROM wide")
    + "SELECT strategy, label, m AS n FROM n, (VALUES ('smote'),('borderline')) s(strategy), (VALUES (0),(1)) l(label)",
)
def smote_class_counts(spark, sf):
    w, out = wide(spark, sf), None
    for name, make in (("smote", augment.smote), ("borderline", augment.borderline_smote)):
        c = make(w, SM_FEATURES, "label", "row_key").groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("strategy"), "label", "n")
        out = c if out is None else out.unionByName(c)
    return out


@query("margin_smote_counts", "A3")
def margin_smote_counts(spark, sf):
    return augment.margin_smote(wide(spark, sf), SM_FEATURES, "label", "row_key").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "augmentation_of_balanced_data", "A4 U5",
    sql_with("wide", b=f"""SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql_order_key(9, 'row_key')}, row_key) AS rn,
      (SELECT min(c) FROM (SELECT count(*) AS c FROM wide GROUP BY label)) AS m FROM wide""")
    + "SELECT label, count(*) AS n FROM (SELECT DISTINCT label, qty, size, price, disc, tax FROM b WHERE rn <= m) GROUP BY label",
)
def augmentation_of_balanced_data(spark, sf):
    """On balanced classes all three strategies add nothing: the result is the distinct original rows."""
    from windowlab.operators.ranking import hash_ranks

    w = wide(spark, sf)
    _, n_min, _, _ = augment.class_sizes(w, "label")
    even = stored(hash_ranks(w, ["label"], 9, "row_key").where(F.col("rn") <= n_min).drop("rn", "n_part"), "even")
    return augment.augment(even, ["qty", "size", "price", "disc", "tax"], "label", "row_key").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# ---- composed experiments ------------------------------------------------------------------------

def ablation_results(spark, sf, configs, seeds, source="static"):
    """Per (config, seed): accuracy of a ridge detector on source test and whole target.

    A ridge fit is one normal-equation pass and its score is a linear column, so all configurations of a
    seed are judged in a single scan of the prepared windows.
    """
    out = None
    for seed in seeds:
        d = prepared(spark, sf, seed, source)
        train = d.where("part = 'train'")
        n = train.count()
        cells = []
        for config, feats in configs.items():
            m = models.fit_ridge(models.assemble(train, feats), 1.0, n)
            score = models.linear_score(m, feats)
            right = F.avg(((score >= 0).cast("int") == F.col("label")).cast("double"))
            cells.append(F.struct(F.lit(config).alias("config"), F.lit(len(feats)).alias("n_kept"), right.alias("acc")))
        r = d.where("part IN ('test', 'target')").groupBy("part").agg(F.array(*cells).alias("_c"))
        r = r.select("part", F.lit(seed).alias("seed"), F.inline("_c")).select("config", "n_kept", "seed", "part", "acc")
        out = r if out is None else out.unionByName(r)
    return stored(out, "ablation")


RIDGE_GRID_SQL = dict(
    rk=run_rank_sql([42, 43]),
    sp=SPLIT_SQL,
    al="SELECT seed, domain, part, qty, disc, label FROM wide JOIN sp USING (domain, run_id)",
    st="SELECT seed, avg(qty) AS mq, stddev_pop(qty) AS sq, avg(disc) AS md, stddev_pop(disc) AS sd FROM al WHERE domain='static' AND part='train' GROUP BY seed",
    z="""SELECT seed, CASE WHEN domain='static' THEN part ELSE 'target' END AS part, (qty-mq)/sq AS x1, (disc-md)/sd AS x2, label, 2.0::DOUBLE*label-1 AS t
        FROM al JOIN st USING (seed)""",
    m="SELECT seed, avg(x1) AS m1, avg(x2) AS m2, avg(t) AS mt FROM z WHERE part='train' GROUP BY seed",
    ss="""SELECT seed, max(m1) AS m1, max(m2) AS m2, max(mt) AS mt, sum((x1-m1)*(x1-m1))+1 AS a, sum((x2-m2)*(x2-m2))+1 AS b, sum((x1-m1)*(x2-m2)) AS c,
        sum((x1-m1)*(t-mt)) AS p, sum((x2-m2)*(t-mt)) AS q FROM z JOIN m USING (seed) WHERE part='train' GROUP BY seed""",
    w="""SELECT seed, m1, m2, mt, 'full' AS config, 2 AS n_kept, (b*p-c*q)/(a*b-c*c) AS w1, (a*q-c*p)/(a*b-c*c) AS w2 FROM ss
        UNION ALL SELECT seed, m1, m2, mt, 'minus_qty', 1, 0, q/b FROM ss UNION ALL SELECT seed, m1, m2, mt, 'minus_disc', 1, p/a, 0 FROM ss""",
)


@query(
    "ridge_ablation_grid", "C1 C7 C8 C9 T2 R10",
    sql_with("wide", **RIDGE_GRID_SQL) + """SELECT config, n_kept, CAST(seed AS INTEGER) AS seed, part,
      round(avg(CASE WHEN (mt + w1*(x1-m1) + w2*(x2-m2) >= 0) = (label=1) THEN 1.0::DOUBLE ELSE 0 END),6) AS acc
      FROM z JOIN w USING (seed) WHERE (part IN ('test','target')) GROUP BY 1,2,3,4""",
)
def ridge_ablation_grid(spark, sf):
    """Split, scaling, fit and scoring per (configuration, seed); two features, so that SQL can solve the fit."""
    configs = {"full": ["qty", "disc"], "minus_qty": ["disc"], "minus_disc": ["qty"]}
    return rounded(ablation_results(spark, sf, configs, [42, 43]), ["acc"])


@query("ablation_breakdown", "C7 C8 R10 J2")
def ablation_breakdown(spark, sf):
    """Removal configurations against the full set, summary with paired deltas on the target."""
    configs = {"full": FEATURES, "minus_qty": ["disc", "tax", "size", "price"], "minus_tax": ["qty", "disc", "size", "price"]}
    r = ablation_results(spark, sf, configs, [42, 43, 44]).where("part = 'target'")
    s = r.groupBy("config").agg(F.max("n_kept").alias("n_kept"), F.avg("acc").alias("acc_mean"), F.stddev_samp("acc").alias("acc_std"))
    d = stats.paired_stats(joins.pair_with_baseline(r, "config", "full", ["seed"], ["acc"]), ["config"], "delta_acc")
    return rounded(s.join(d.select("config", "delta_mean", "delta_std", "paired_p", "cohens_d_paired"), "config", "left"), ["acc_mean", "acc_std", "delta_mean", "delta_std", "paired_p", "cohens_d_paired"])


@query("drop_column_importance", "C9 X10 X12")
def drop_column_importance(spark, sf):
    """Accuracy lost on the source test part without one column, per seed, with a t-test against 0."""
    configs = {"all": FEATURES} | {f: [c for c in FEATURES if c != f] for f in FEATURES[:3]}
    r = ablation_results(spark, sf, configs, [42, 43, 44]).where("part = 'test'")
    p = joins.pair_with_baseline(r, "config", "all", ["seed"], ["acc"]).withColumn("drop", -F.col("delta_acc"))
    return rounded(stats.mean_t_interval(p, ["config"], "drop"), ["mean", "std", "ci_lo", "ci_hi", "cohens_d", "t_stat", "p_value"])


@query("both_directions_cell", "C3")
def both_directions_cell(spark, sf):
    """The same cell in both directions and the asymmetry of the transfer accuracies."""
    out = None
    for source, name in (("static", "SM"), ("mobile", "MS")):
        d = prepared(spark, sf, 42, source)
        c = cell(d, models.logistic(1.0, d.where("part = 'train'").count())).select(F.lit(name).alias("direction"), "part", "accuracy", "auc")
        out = c if out is None else out.unionByName(c)
    at = lambda d, p: F.max(F.when((F.col("direction") == d) & (F.col("part") == p), F.col("accuracy")))
    r = out.agg(at("SM", "test").alias("acc_S"), at("MS", "test").alias("acc_M"), at("SM", "target").alias("acc_SM"), at("MS", "target").alias("acc_MS"))
    return rounded(r.withColumn("asymmetry", F.abs(F.col("acc_SM") - F.col("acc_MS"))), ["acc_S", "acc_M", "acc_SM", "acc_MS", "asymmetry"])


@query("in_domain_pipeline", "C18")
def in_domain_pipeline(spark, sf):
    """Split, robust scaling, filters, augmentation, training, thresholds and leaderboard in one domain."""
    feats = ["qty", "disc", "tax", "size", "price", "qty_dup"]
    w = splits.split_windows(wide(spark, sf).where("domain = 'static'"), ["domain"], "run_id", [42])
    params = scaling.fit_robust(w.where("part = 'train'"), [], feats)
    z = stored(scaling.apply_scaler(w, params, [], feats).select("row_key", "run_id", "label", "part", *feats), "scaled")
    train = z.where("part = 'train'")
    kept = selection.filter_features(train, feats)
    grown = stored(augment.smote(train, kept, "label", "row_key"), "grown")
    x, rest = models.assemble(grown, kept), models.assemble(z.where("part <> 'train'"), kept)
    out = None
    for name, est in (("lr", models.logistic(1.0, grown.count())), ("rf", models.random_forest(6, 5)), ("gbt", models.boosted(5, 3))):
        s = stored(models.scored(est.fit(x), rest, ["part", F.col("label").cast("int").alias("y")]), "scored")
        t = metrics.best_threshold(s.where("part = 'val'"), [], "y", "score", grid=(10, 89)).select("t")
        test = s.where("part = 'test'").join(F.broadcast(t))
        m = metrics.measures(metrics.confusion(test, ["t"], "y", (F.col("score") >= F.col("t") / 100.0).cast("int"))).withColumn("model", F.lit(name))
        out = m if out is None else out.unionByName(m)
    names = ["accuracy", "precision", "recall", "f1", "mcc", "kappa"]
    board = metrics.leaderboard(out, "accuracy", "model", 15).withColumn("features", F.lit(";".join(kept)))
    return rounded(board.select("model", "t", *names, "features"), names)


@query(
    "tuned_parameter_lookup", "S8",
    """WITH b AS (SELECT CASE WHEN l_linestatus='F' THEN 'static' ELSE 'mobile' END AS domain, l_returnflag AS model, max(l_linenumber) AS depth, max(l_quantity) AS iterations
      FROM lineitem WHERE l_returnflag<>'R' GROUP BY 1, 2), g AS (SELECT DISTINCT CASE WHEN l_linestatus='F' THEN 'static' ELSE 'mobile' END AS domain, l_returnflag AS model FROM lineitem)
    SELECT domain, model, coalesce(CAST(depth AS VARCHAR), '7') AS depth, coalesce(CAST(CAST(iterations AS INTEGER) AS VARCHAR), '800') AS iterations, 2 AS n_params FROM g LEFT JOIN b USING (domain, model)""",
)
def tuned_parameter_lookup(spark, sf):
    """Best parameters per (domain, model), unknown names removed, defaults where a model was not searched."""
    from windowlab.constants import ALLOWED_PARAMS
    from windowlab.fixtures import table

    l = table(spark, sf, "lineitem").withColumns({"domain": F.when(F.col("l_linestatus") == "F", "static").otherwise("mobile"), "model": F.col("l_returnflag")})
    best = l.where("l_returnflag <> 'R'").groupBy("domain", "model").agg(F.create_map(
        F.lit("depth"), F.max("l_linenumber").cast("string"), F.lit("iterations"), F.max("l_quantity").cast("int").cast("string"),
        F.lit("verbose"), F.lit("0")).alias("params"))
    grid = l.select("domain", "model").distinct()
    out = scans.tuned_params(grid, best, ALLOWED_PARAMS["catboost"], {"depth": "7", "iterations": "800"})
    return out.select("domain", "model", F.col("params")["depth"].alias("depth"), F.col("params")["iterations"].alias("iterations"), F.size("params").alias("n_params"))

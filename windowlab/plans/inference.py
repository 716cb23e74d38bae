"""Queries: effect sizes, paired tests, variance decomposition, bootstrap and permutation."""

from __future__ import annotations

from pyspark.sql import functions as F

from windowlab.fixtures import MANY, many, scores, seed_results, sql_with, wide
from windowlab.functions.expressions import logit
from windowlab.functions.hashing import sql_key_code, sql_poisson, sql_poly_hash, sql_replicates, sql_order_key
from windowlab.operators import joins, metrics, resample, stats
from windowlab.plans.registry import query
from windowlab.plans.scoring import CM_SQL, KEYS, predicted, threshold_sql, thresholded
from windowlab.session import stored

FEATURES = ["qty", "disc", "tax", "size", "price"]
TWO = ["qty", "disc"]


def rounded(df, names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


# ---- paired analyses over seeds ---------------------------------------------------

PAIR_SQL = dict(
    pr="""SELECT e.config, e.direction, e.seed, e.acc - b.acc AS delta_acc, e.auc - b.auc AS delta_auc FROM seed_results e
       JOIN seed_results b ON e.seed=b.seed AND e.direction=b.direction AND b.config='A' WHERE e.config<>'A'""",
    lg="SELECT config, direction, seed, 'acc' AS metric, delta_acc AS d FROM pr UNION ALL SELECT config, direction, seed, 'auc', delta_auc FROM pr",
)


def paired(spark, sf):
    p = joins.pair_with_baseline(seed_results(spark, sf), "config", "A", ["seed", "direction"], ["acc", "auc"])
    return p.select("config", "direction", "seed", F.col("delta_acc").alias("acc"), F.col("delta_auc").alias("auc"))


@query("paired_deltas", "J4 D9", sql_with("seed_results", **PAIR_SQL) + "SELECT config, direction, seed, round(delta_acc,8) AS acc, round(delta_auc,8) AS auc FROM pr")
def paired_deltas(spark, sf):
    return rounded(paired(spark, sf), ["acc", "auc"], 8)


@query(
    "paired_analysis", "X10",
    sql_with("seed_results", **PAIR_SQL) + """SELECT config, direction, metric, count(*) AS n_seeds, round(avg(d),8) AS delta_mean, round(stddev_samp(d),8) AS delta_std,
      round(quantile_cont(d,0.025),8) AS delta_ci_lo, round(quantile_cont(d,0.975),8) AS delta_ci_hi,
      round(avg(d)/(stddev_samp(d)/sqrt(count(*))),5) AS paired_t, round(avg(d)/stddev_samp(d),5) AS cohens_d_paired FROM lg GROUP BY 1,2,3""",
)
def paired_analysis(spark, sf):
    long = paired(spark, sf).unpivot(["config", "direction", "seed"], ["acc", "auc"], "metric", "d")
    p = stats.paired_stats(long, ["config", "direction", "metric"], "d")
    p = rounded(p, ["delta_mean", "delta_std", "delta_ci_lo", "delta_ci_hi"], 8)
    return rounded(p, ["paired_t", "cohens_d_paired"], 5).drop("paired_p")


def t19_two_sided(t: str) -> str:
    """Two-sided tail of Student's t for 19 degrees of freedom: the finite trigonometric sum of odd degrees."""
    theta, terms, c = f"atan(abs({t})/sqrt(19.0::DOUBLE))", [], 1.0
    for k in range(1, 10):
        if k > 1:
            c *= (2 * k - 2) / (2 * k - 1)
        terms.append(f"{c!r}::DOUBLE*power(cos({theta}),{2 * k - 1})")
    return f"(1 - 2/pi()*({theta} + sin({theta})*({' + '.join(terms)})))"


@query(
    "paired_p_values", "X10 X12",
    sql_with("seed_results", **PAIR_SQL, tt="SELECT config, direction, metric, count(*) AS n_seeds, avg(d)/(stddev_samp(d)/sqrt(count(*))) AS t FROM lg GROUP BY 1,2,3")
    + f"SELECT config, direction, metric, n_seeds, round(t,5) AS paired_t, round({t19_two_sided('t')},6) AS paired_p FROM tt",
)
def paired_p_values(spark, sf):
    """Two-sided p-values of the paired tests over 20 seeds."""
    long = paired(spark, sf).unpivot(["config", "direction", "seed"], ["acc", "auc"], "metric", "d")
    return stats.paired_stats(long, ["config", "direction", "metric"], "d").select(
        "config", "direction", "metric", "n_seeds", F.round("paired_t", 5).alias("paired_t"), F.round("paired_p", 6).alias("paired_p"))


# t quantile at .975 with 19 degrees of freedom (20 seeds), a table value, for the oracle.
T19 = 2.093024054408263


@query(
    "mean_t_interval", "X11 X12",
    sql_with("seed_results") + f"""SELECT config, direction, count(*) AS n, round(avg(acc),7) AS mean, round(stddev_samp(acc),7) AS std,
      round(avg(acc) - {T19}::DOUBLE*stddev_samp(acc)/sqrt(20),7) AS ci_lo, round(avg(acc) + {T19}::DOUBLE*stddev_samp(acc)/sqrt(20),7) AS ci_hi,
      round(avg(acc)/stddev_samp(acc),4) AS cohens_d, round(avg(acc)/(stddev_samp(acc)/sqrt(20)),4) AS t_stat FROM seed_results GROUP BY 1, 2""",
)
def mean_t_interval(spark, sf):
    m = stats.mean_t_interval(seed_results(spark, sf), ["config", "direction"], "acc")
    return rounded(rounded(m, ["mean", "std", "ci_lo", "ci_hi"], 7), ["cohens_d", "t_stat"], 4).drop("p_value")


@query(
    "cell_summary", "X13",
    sql_with("seed_results", lg="SELECT config, direction, 'acc' AS metric, acc AS v FROM seed_results UNION ALL SELECT config, direction, 'auc', auc FROM seed_results")
    + """SELECT config, direction, metric, round(avg(v),8) AS mean, round(stddev_samp(v),8) AS std, round(quantile_cont(v,0.025),8) AS ci_lo,
      round(quantile_cont(v,0.975),8) AS ci_hi FROM lg GROUP BY 1,2,3""",
)
def cell_summary(spark, sf):
    return rounded(stats.cell_summary(seed_results(spark, sf), ["config", "direction"], ["acc", "auc"]), ["mean", "std", "ci_lo", "ci_hi"], 8)


@query(
    "summary_with_deltas", "J2",
    sql_with("seed_results", **PAIR_SQL, s="SELECT config, avg(acc) AS m, stddev_samp(acc) AS s FROM seed_results WHERE direction='SM' GROUP BY 1",
             d="SELECT config, avg(delta_acc) AS delta FROM pr WHERE direction='SM' GROUP BY 1")
    + "SELECT config, round(m,8) AS acc_mean, round(s,8) AS acc_std, round(delta,8) AS delta_acc FROM s LEFT JOIN d USING (config)",
)
def summary_with_deltas(spark, sf):
    r = seed_results(spark, sf).where("direction = 'SM'")
    s = r.groupBy("config").agg(F.avg("acc").alias("acc_mean"), F.stddev_samp("acc").alias("acc_std"))
    d = paired(spark, sf).where("direction = 'SM'").groupBy("config").agg(F.avg("acc").alias("delta_acc"))
    return rounded(s.join(d, "config", "left"), ["acc_mean", "acc_std", "delta_acc"], 8)


@query(
    "control_noise", "X17 X18",
    sql_with("seed_results", **PAIR_SQL, d="SELECT direction, config, avg(delta_acc) AS x FROM pr GROUP BY 1, 2",
             t="SELECT direction, max(abs(x)) AS total FROM d GROUP BY 1")
    + """SELECT direction, count(*) AS n_controls, round(avg(x),9) AS mean, round(stddev_samp(x),9) AS std, round(max(abs(x)),9) AS max_abs,
      CASE WHEN max(total) > 1e-6 THEN round(100*avg(x)/max(total),3) END AS pct_of_total FROM d JOIN t USING (direction) GROUP BY 1""",
)
def control_noise(spark, sf):
    d = paired(spark, sf).groupBy("direction", "config").agg(F.avg("acc").alias("x"))
    n = stats.noise_summary(d, ["direction"], "x")
    n = n.withColumn("pct_of_total", F.round(stats.share_of_total(n, "mean", F.col("max_abs"), 1e-6), 3))
    return rounded(n, ["mean", "std", "max_abs"], 9)


# ---- variance decomposition, distances --------------------------------------------

@query(
    "variance_decomposition", "X14",
    sql_with("wide", u=" UNION ALL ".join(f"SELECT domain, run_id, '{c}' AS feature, {c} AS x FROM wide" for c in FEATURES),
             r="SELECT domain, feature, run_id, var_samp(x) AS w, avg(x) AS b FROM u GROUP BY 1,2,3")
    + """SELECT domain, feature, round(avg(w)/(var_samp(b)+1e-12),5) AS ratio, avg(w)/(var_samp(b)+1e-12) >= 0.5 AS passes FROM r GROUP BY 1, 2""",
)
def variance_decomposition(spark, sf):
    v = stats.variance_ratio(wide(spark, sf), ["domain"], "run_id", FEATURES)
    return v.select("domain", "feature", F.round("ratio", 5).alias("ratio"), "passes")


@query(
    "failing_feature_share", "X15",
    sql_with("wide", wr="SELECT *, CAST(CAST(run_id AS BIGINT) % 7 AS DOUBLE) AS run_setting FROM wide",
             u=" UNION ALL ".join(f"SELECT domain, run_id, label, '{c}' AS feature, {c} AS x FROM wr" for c in [*FEATURES, "run_setting"]),
             r="SELECT domain, feature, run_id, var_samp(x) AS w, avg(x) AS b FROM u GROUP BY 1,2,3",
             v="SELECT domain, feature, avg(w)/(var_samp(b)+1e-12) >= 0.5 AS passes FROM r GROUP BY 1, 2",
             i="SELECT domain, feature, abs(corr(x, label)) AS importance FROM u GROUP BY 1, 2")
    + """SELECT domain, count(*) FILTER (NOT passes) AS n_failing,
      round(coalesce(sum(importance) FILTER (NOT passes), 0)/sum(importance), 5) AS failing_share FROM i JOIN v USING (domain, feature) GROUP BY 1""",
)
def failing_feature_share(spark, sf):
    """Share of importance (absolute correlation with the label) held by features whose variance lies between runs; one feature is a setting of the run."""
    w, features = wide(spark, sf).withColumn("run_setting", (F.col("run_id").cast("bigint") % 7).cast("double")), [*FEATURES, "run_setting"]
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.abs(F.corr(f, "label")).alias("importance")) for f in features])
    imp = w.groupBy("domain").agg(cells.alias("_c")).select("domain", F.inline("_c"))
    out = stats.failing_share(imp, stats.variance_ratio(w, ["domain"], "run_id", features), ["domain"])
    return out.withColumn("failing_share", F.round("failing_share", 5))


@query(
    "score_drift_distance", "X16",
    sql_with("scores", z="SELECT model, domain='static' AS s, ln(q/(1-q)) AS x FROM (SELECT model, domain, greatest(1e-6::DOUBLE, least(1-1e-6::DOUBLE, score)) AS q FROM scores)",
             c="SELECT model, x, count(*) FILTER (s) AS a, count(*) FILTER (NOT s) AS b FROM z GROUP BY 1, 2",
             f="""SELECT model, x, sum(a) OVER w/sum(a) OVER (PARTITION BY model) AS fa, sum(b) OVER w/sum(b) OVER (PARTITION BY model) AS fb,
               lead(x) OVER (PARTITION BY model ORDER BY x) AS nx FROM c WINDOW w AS (PARTITION BY model ORDER BY x)""")
    + "SELECT model, round(sum(abs(fa-fb)*(nx-x))::DOUBLE,5) AS w1 FROM f GROUP BY 1",
)
def score_drift_distance(spark, sf):
    s = scores(spark, sf).select("model", "domain", logit(F.col("score")).alias("z"))
    return rounded(stats.wasserstein(s, ["model"], "domain", "static", "z"), ["w1"], 5)


def two_feature_sql(source: str, keys: str, w: str = "1", group: str = "domain") -> dict[str, str]:
    """Closed form of both separation measures for two features, from weighted sums."""
    return dict(
        g=f"""SELECT {keys}, {group} AS grp, label, sum({w})::DOUBLE AS n, sum({w}*qty) AS t1, sum({w}*disc) AS t2, sum({w}*qty*qty) AS c11,
            sum({w}*qty*disc) AS c12, sum({w}*disc*disc) AS c22 FROM {source} GROUP BY {keys}, {group}, label""",
        h=f"""SELECT {keys}, grp, sum(n) AS n, max(n) FILTER (label=0) AS n0, max(n) FILTER (label=1) AS n1,
            max(t1/n) FILTER (label=1) - max(t1/n) FILTER (label=0) AS d1, max(t2/n) FILTER (label=1) - max(t2/n) FILTER (label=0) AS d2,
            sqrt(sum(c11)/sum(n) - (sum(t1)/sum(n))*(sum(t1)/sum(n))) AS s1, sqrt(sum(c22)/sum(n) - (sum(t2)/sum(n))*(sum(t2)/sum(n))) AS s2,
            sum(c11 - t1*t1/n) AS w11, sum(c12 - t1*t2/n) AS w12, sum(c22 - t2*t2/n) AS w22 FROM g GROUP BY {keys}, grp""",
        i=f"SELECT {keys}, grp, n, n0, n1, d1/s1 AS d1, d2/s2 AS d2, w11/(s1*s1) AS w11, w12/(s1*s2) AS w12, w22/(s2*s2) AS w22 FROM h",
        j=f"SELECT *, w11/(n-2)+1e-6 AS a, w22/(n-2)+1e-6 AS b, w12/(n-2) AS c FROM i",
        se=f"""SELECT {keys}, grp, sqrt((d1*d1*b - 2*d1*d2*c + d2*d2*a)/(a*b-c*c)) AS mahalanobis,
            n0*n1/n*(d1*d1*w22 - 2*d1*d2*w12 + d2*d2*w11)/(w11*w22-w12*w12) AS lda_ratio FROM j""",
    )


@query(
    "class_separation", "X4 X5",
    sql_with("wide", src="SELECT 0 AS rep, * FROM wide", **two_feature_sql("src", "rep")) + "SELECT rep, grp, round(mahalanobis,6) AS mahalanobis, round(lda_ratio,6) AS lda_ratio FROM se",
)
def class_separation(spark, sf):
    g = resample.full_grams(wide(spark, sf), TWO, "label", "domain")
    return rounded(resample.separation(g, len(TWO)), ["mahalanobis", "lda_ratio"])


@query("class_separation_all_features", "X4 X5")
def class_separation_all_features(spark, sf):
    g = resample.full_grams(wide(spark, sf), FEATURES, "label", "domain")
    return rounded(resample.separation(g, len(FEATURES)), ["mahalanobis", "lda_ratio"])


MANY_PAIRS = [(a, b) for i, a in enumerate(MANY) for b in MANY[i:]]


@query(
    "class_moments_wide", "X4 X5",
    sql_with(
        "many", c="SELECT * FROM many WHERE " + " AND ".join(f"{m} IS NOT NULL" for m in MANY),
        s="SELECT domain AS grp, label, count(*)::DOUBLE AS n, [" + ", ".join(f"sum({m})" for m in MANY) + "] AS t, [" + ", ".join(f"sum({a}*{b})" for a, b in MANY_PAIRS) + "] AS q FROM c GROUP BY 1, 2",
    ) + "SELECT grp, label, CAST(unnest(range(1, 1 + 1 + 32 + 528)) AS INTEGER) AS pos, unnest(list_concat([n], t, q)) AS v FROM s",
)
def class_moments_wide(spark, sf):
    """Counts, sums and cross products of 32 features with nulls per domain and class: what separation and its replicates build on."""
    g = resample.full_grams(many(spark, sf), MANY, "label", "domain")
    return g.select("grp", "label", F.posexplode("sums").alias("pos", "v")).withColumn("pos", F.col("pos") + 1)


# ---- bootstrap ----------------------------------------------------------------------

N_BOOT = 100


def boot_sql(unit: str, seed: int, n: int, source: str, cols: str) -> dict[str, str]:
    return dict(
        rp=sql_replicates(seed, n),
        bx=f"SELECT {cols}, {sql_key_code(unit)} FROM {source}",
        bw=f"SELECT * FROM (SELECT bx.*, rep, {sql_poisson(sql_poly_hash())} AS w FROM bx, rp) WHERE w > 0",
    )


@query(
    "bootstrap_separation", "P7 X6",
    sql_with("wide", **boot_sql("row_key", 42, N_BOOT, "wide", "domain, label, qty, disc"), **two_feature_sql("bw", "rep", "w"))
    + "SELECT rep, grp, round(mahalanobis,6) AS mahalanobis, round(lda_ratio,6) AS lda_ratio FROM se",
)
def bootstrap_separation(spark, sf):
    g = resample.bootstrap_grams(wide(spark, sf), TWO, "label", "domain", ["row_key"], N_BOOT, 42)
    return rounded(resample.separation(g, len(TWO)), ["mahalanobis", "lda_ratio"])


SUMMARY_SQL = """count(*) AS n_replicates, round(avg(value),6) AS mean, round(stddev_samp(value),6) AS std,
  round(quantile_cont(value,0.025),6) AS ci_lo, round(quantile_cont(value,0.975),6) AS ci_hi"""


@query(
    "bootstrap_summary", "X6 X9",
    sql_with("wide", **boot_sql("row_key", 42, N_BOOT, "wide", "domain, label, qty, disc"), **two_feature_sql("bw", "rep", "w"),
             su="SELECT grp, quantile_cont(mahalanobis,0.025) AS lo, quantile_cont(mahalanobis,0.975) AS hi, avg(mahalanobis) AS m, stddev_samp(mahalanobis) AS s FROM se GROUP BY grp")
    + """SELECT a.grp, round(a.m,6) AS mean, round(a.s,6) AS std, round(a.lo,6) AS ci_lo, round(a.hi,6) AS ci_hi,
      NOT (a.hi < b.lo OR b.hi < a.lo) AS overlaps FROM su a JOIN su b ON a.grp <> b.grp""",
)
def bootstrap_summary(spark, sf):
    g = resample.bootstrap_grams(wide(spark, sf), TWO, "label", "domain", ["row_key"], N_BOOT, 42)
    s = resample.replicate_summary(resample.separation(g, len(TWO)), ["grp"], "mahalanobis")
    o = s.select(F.col("grp").alias("_o"), F.col("ci_lo").alias("_lo"), F.col("ci_hi").alias("_hi"))
    j = s.join(o, F.col("grp") != F.col("_o"))  # two rows, one per domain
    j = j.withColumn("overlaps", ~((F.col("ci_hi") < F.col("_lo")) | (F.col("_hi") < F.col("ci_lo"))))
    return rounded(j.select("grp", "mean", "std", "ci_lo", "ci_hi", "overlaps"), ["mean", "std", "ci_lo", "ci_hi"])


@query(
    "bootstrap_welch", "X8",
    sql_with("wide", **boot_sql("row_key", 42, N_BOOT, "wide", "domain, label, qty, disc"), **two_feature_sql("bw", "rep", "w"),
             m="""SELECT count(*) FILTER (grp='static') AS n0, count(*) FILTER (grp='mobile') AS n1, avg(mahalanobis) FILTER (grp='static') AS m0,
               avg(mahalanobis) FILTER (grp='mobile') AS m1, var_samp(mahalanobis) FILTER (grp='static') AS v0, var_samp(mahalanobis) FILTER (grp='mobile') AS v1 FROM se""",
             st="""SELECT (m1-m0)/sqrt(v0/n0+v1/n1) AS t, (v0/n0+v1/n1)*(v0/n0+v1/n1)/(v0/n0*v0/n0/(n0-1)+v1/n1*v1/n1/(n1-1)) AS v FROM m""",
             # Simpson's rule over the density from 0 to t
             ar="""SELECT t/4000/3*exp(lgamma((v+1)/2)-lgamma(v/2))/sqrt(pi()*v)
               *sum((CASE WHEN i IN (0, 4000) THEN 1 ELSE 2+2*(i%2) END)*pow(1+(t*i/4000)*(t*i/4000)/v, -(v+1)/2)) AS a FROM st, range(4001) AS g(i) GROUP BY t, v""")
    + """SELECT 'mahalanobis' AS measure, round(m1-m0,6) AS mean_diff, round((m1-m0)/sqrt(v0/n0+v1/n1),3) AS t_stat,
      round((v0/n0+v1/n1)*(v0/n0+v1/n1)/(v0/n0*v0/n0/(n0-1)+v1/n1*v1/n1/(n1-1)),3) AS dof, round((m1-m0)/sqrt(0.5::DOUBLE*(v0+v1)),3) AS cohens_d,
      round(greatest(0.5::DOUBLE - a, 0), 6) AS p_value FROM m, ar""",
)
def bootstrap_welch(spark, sf):
    g = resample.bootstrap_grams(wide(spark, sf), TWO, "label", "domain", ["row_key"], N_BOOT, 42)
    s = resample.separation(g, len(TWO)).withColumn("measure", F.lit("mahalanobis"))
    w = stats.welch(s, ["measure"], "grp", "static", "mobile", "mahalanobis")
    return rounded(rounded(w, ["mean_diff", "p_value"], 6), ["t_stat", "dof", "cohens_d"], 3)


N_CLUSTER = 2000


@query(
    "cluster_bootstrap_accuracy", "P8",
    sql_with("scores", b=threshold_sql(), ru="""SELECT s.domain, s.model, run_id, count(*) AS n, count(*) FILTER ((score >= t/100.0::DOUBLE) = (y=1)) AS k
      FROM scores s JOIN b USING (domain, model) GROUP BY 1,2,3""", **boot_sql("run_id", 7, N_CLUSTER, "ru", "domain, model, run_id, n, k"),
             v="SELECT domain, model, rep, sum(w*k)::DOUBLE/sum(w*n) AS value FROM bw GROUP BY 1,2,3")
    + f"SELECT domain, model, {SUMMARY_SQL} FROM v GROUP BY 1, 2",
)
def cluster_bootstrap_accuracy(spark, sf):
    s = thresholded(spark, sf)
    runs = resample.run_sums(s, KEYS, "run_id", n=F.lit(1), k=(predicted() == F.col("y")).cast("int"))
    reps = resample.cluster_bootstrap(runs, KEYS, "run_id", ["n", "k"], lambda n, k: k / n, N_CLUSTER, 7)
    return rounded(resample.replicate_summary(reps, KEYS), ["mean", "std", "ci_lo", "ci_hi"])


@query(
    "cluster_bootstrap_auc", "P8 M5",
    sql_with("scores", ce="SELECT domain, model, run_id, score, sum(y) AS p, sum(1-y) AS q FROM scores GROUP BY 1,2,3,4",
             **boot_sql("run_id", 7, N_CLUSTER, "ce", "domain, model, run_id, score, p, q"),
             sc="SELECT domain, model, rep, score, sum(w*p)::DOUBLE AS p, sum(w*q)::DOUBLE AS q FROM bw GROUP BY 1,2,3,4",
             sp="""SELECT *, coalesce(sum(q) OVER (PARTITION BY domain, model, rep ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS qb FROM sc""",
             v="SELECT domain, model, rep, sum(p*(qb+q/2))/(sum(p)*sum(q)) AS value FROM sp GROUP BY 1,2,3")
    + f"SELECT domain, model, {SUMMARY_SQL} FROM v GROUP BY 1, 2",
)
def cluster_bootstrap_auc(spark, sf):
    reps = resample.cluster_bootstrap_auc(scores(spark, sf), KEYS, "run_id", "y", "score", N_CLUSTER, 7)
    return rounded(resample.replicate_summary(reps, KEYS), ["mean", "std", "ci_lo", "ci_hi"])


# ---- permutation ----------------------------------------------------------------------

N_PERM = 1000

PERM_SQL = dict(
    rp=sql_replicates(12345, N_PERM),
    px=f"SELECT domain, label, qty, disc, {sql_key_code('row_key')} FROM wide",
    pu=f"SELECT px.*, rep, {sql_poly_hash()} AS u FROM px, rp",
    pk="SELECT rep, label, qty, disc, row_number() OVER (PARTITION BY rep ORDER BY u, x, y) <= (SELECT count(*) FROM wide WHERE domain='static') AS s FROM pu",
    ps="SELECT rep, label, qty, disc, CASE WHEN s THEN 'static' ELSE 'mobile' END AS pd FROM pk",
)
PERM_DIFF = "SELECT rep, max(mahalanobis) FILTER (grp='mobile') - max(mahalanobis) FILTER (grp='static') AS value FROM se GROUP BY rep"


def permuted(spark, sf):
    g = resample.permutation_grams(wide(spark, sf), TWO, "label", "domain", ["row_key"], N_PERM, 12345)
    s = resample.separation(g, len(TWO))
    side = lambda d: F.max(F.when(F.col("grp") == d, F.col("mahalanobis")))
    return s.groupBy("rep").agg((side("mobile") - side("static")).alias("value"))


@query(
    "permutation_null", "P10",
    sql_with("wide", **PERM_SQL, **two_feature_sql("ps", "rep", group="pd"), v=PERM_DIFF) + "SELECT rep, round(value,6) AS value FROM v",
)
def permutation_null(spark, sf):
    return rounded(permuted(spark, sf), ["value"])


@query(
    "permutation_test", "X7 P10",
    sql_with("wide", **PERM_SQL, **two_feature_sql("ps", "rep", group="pd"), v=PERM_DIFF, src="SELECT 0 AS rep, * FROM wide",
             **{f"o{k}": q.replace("FROM g ", "FROM og ").replace("FROM h", "FROM oh").replace("FROM i", "FROM oi").replace("FROM j", "FROM oj")
                for k, q in two_feature_sql("src", "rep").items()},
             ob="SELECT max(mahalanobis) FILTER (grp='mobile') - max(mahalanobis) FILTER (grp='static') AS obs FROM ose")
    + """SELECT round(max(obs),6) AS observed, count(*) AS n_permutations, count(*) FILTER (value >= obs) AS n_exceed,
      round((count(*) FILTER (value >= obs)+1)::DOUBLE/(count(*)+1),6) AS p_value, round(avg(value),6) AS null_mean,
      round(stddev_samp(value),6) AS null_std, round(max(value),6) AS null_max, round(max(obs)/max(value),4) AS ratio_to_max FROM v, ob""",
)
def permutation_test(spark, sf):
    obs = resample.separation(resample.full_grams(wide(spark, sf), TWO, "label", "domain"), len(TWO))
    side = lambda d: F.max(F.when(F.col("grp") == d, F.col("mahalanobis")))
    obs = obs.agg((side("mobile") - side("static")).alias("obs"))
    out = stats.permutation_summary(permuted(spark, sf), obs, [], "value", "obs")
    return rounded(rounded(out, ["observed", "p_value", "null_mean", "null_std", "null_max"]), ["ratio_to_max"], 4)


N_PERM_ALL = 10_000


@query("permutation_test_all", "X4 X5 X7 P10")
def permutation_test_all(spark, sf):
    """10,000 permutations of the domain label over all features, both measures; too many rows for SQL, which checks the same operators above."""
    w = wide(spark, sf)
    null = stored(resample.separation(resample.permutation_grams(w, FEATURES, "label", "domain", ["row_key"], N_PERM_ALL, 12345), len(FEATURES)), "null")
    real = resample.separation(resample.full_grams(w, FEATURES, "label", "domain"), len(FEATURES))
    out = None
    for measure in ("mahalanobis", "lda_ratio"):
        gap = F.max(F.when(F.col("grp") == "mobile", F.col(measure))) - F.max(F.when(F.col("grp") == "static", F.col(measure)))
        one = stats.permutation_summary(null.groupBy("rep").agg(gap.alias("value")), real.agg(gap.alias("obs")), [], "value", "obs").withColumn("measure", F.lit(measure))
        out = one if out is None else out.unionByName(one)
    return rounded(rounded(out, ["observed", "p_value", "null_mean", "null_std", "null_max"]), ["ratio_to_max"], 4)


def _rank_sql(seed):
    return f"row_number() OVER (ORDER BY {sql_order_key(seed, 'row_key')}, row_key)"


@query(
    "column_shuffle", "P13",
    sql_with("wide", a=f"SELECT row_key, label, {_rank_sql('rows3')} AS rn FROM wide", b=f"SELECT qty, {_rank_sql('values3')} AS rn FROM wide")
    + "SELECT row_key, label, qty AS qty_shuffled FROM a JOIN b USING (rn)",
)
def column_shuffle(spark, sf):
    w = wide(spark, sf).select("row_key", "label", "qty")
    return resample.permute_column(w, "row_key", "qty", 3, "qty_shuffled").select("row_key", "label", "qty_shuffled")

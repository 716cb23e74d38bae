"""Queries: scans, sinks, reshaping and effect sizes on the tall windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from windowlab.constants import CORRELATION_CUT  # noqa: F401  (re-exported for callers)
from windowlab.fixtures import EVENT_METRICS, TEXT_RULES, logs, probes, seed_results, sql_with, statuses, tall, wide
from windowlab.functions.hashing import sql_order_key
from windowlab.operators import joins, reshape, stats
from windowlab.plans.registry import query
from windowlab.session import fresh_path
from windowlab.sources import scans, sinks

KEYS = ["domain", "scenario", "file_source"]
META = KEYS + ["defense_active"]


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


def sql_r6(*cols):
    return ", ".join(f'round({c}, 6) AS {c}' for c in cols)


def windows(spark, sf):
    return reshape.widen(tall(spark, sf), KEYS, EVENT_METRICS, label="defense_active")


@query(
    "tall_to_wide", "R1 R2 R7 R8",
    sql_with("wide_a") + f"SELECT domain, scenario, file_source, defense_active, {sql_r6(*EVENT_METRICS)} FROM wide_a",
)
def tall_to_wide(spark, sf):
    return windows(spark, sf).select(*META, *r6(*EVENT_METRICS))


TEMPORAL = ["StartTime_mean", "EndTime_mean", "Duration_mean", "Duration_std", "Duration_max", "Duration_min", "TimeRange"]


@query(
    "window_timing", "R3 R5 R6",
    sql_with("tall") + """
    SELECT domain, scenario, file_source, count(*) AS n_rows,
      round(coalesce(avg("Duration"), avg("EndTime"-"StartTime"), 40.0::DOUBLE), 6) AS measurement_duration,
      round(coalesce(avg("StartTime"),0), 6) AS "StartTime_mean", round(coalesce(avg("EndTime"),0), 6) AS "EndTime_mean",
      round(coalesce(avg("Duration"),0), 6) AS "Duration_mean", round(coalesce(stddev_samp("Duration"),0), 6) AS "Duration_std",
      round(coalesce(max("Duration"),0), 6) AS "Duration_max", round(coalesce(min("Duration"),0), 6) AS "Duration_min",
      round(max("EndTime")-min("StartTime"), 6) AS "TimeRange"
    FROM tall GROUP BY 1, 2, 3""",
)
def window_timing(spark, sf):
    w = reshape.widen(tall(spark, sf), KEYS, EVENT_METRICS, timing=True, temporal=True, counts=True)
    return w.select(*KEYS, "n_rows", F.round("_measurement_duration", 6).alias("measurement_duration"), *r6(*TEMPORAL))


@query(
    "wide_to_tall", "R4",
    sql_with("wide_a") + """
    SELECT domain, scenario, file_source, defense_active, 'click' AS "Metric", round(click,6) AS "Value" FROM wide_a
    UNION ALL SELECT domain, scenario, file_source, defense_active, 'error', round(error,6) FROM wide_a
    UNION ALL SELECT domain, scenario, file_source, defense_active, 'purchase', round(purchase,6) FROM wide_a
    UNION ALL SELECT domain, scenario, file_source, defense_active, 'signup', round(signup,6) FROM wide_a
    UNION ALL SELECT domain, scenario, file_source, defense_active, 'view', round("view",6) FROM wide_a""",
)
def wide_to_tall(spark, sf):
    return reshape.melt(windows(spark, sf), META, EVENT_METRICS).withColumn("Value", F.round("Value", 6))


@query(
    "feature_set_projection", "R9",
    sql_with("wide_a") + "SELECT domain, scenario, file_source, round(click,6) AS click, round(error,6) AS error, "
    'round("view",6) AS "view", 0.0::DOUBLE AS "CDR" FROM wide_a',
)
def feature_set_projection(spark, sf):
    named = {"observable": ["click", "error", "view", "CDR"]}
    w = reshape.project_set(windows(spark, sf), KEYS, named["observable"])
    return w.select(*KEYS, *r6("click", "error", "view"), "CDR")


ABLATIONS = {"all": [], "no_click": ["click"], "no_error_view": ["error", "view"]}


@query(
    "column_ablation_means", "R10",
    sql_with("wide_a") + """
    SELECT 'all' AS config, domain, 5 AS n_kept, round(avg(click+error+purchase+signup+"view"),6) AS mean_sum FROM wide_a GROUP BY domain
    UNION ALL SELECT 'no_click', domain, 4, round(avg(error+purchase+signup+"view"),6) FROM wide_a GROUP BY domain
    UNION ALL SELECT 'no_error_view', domain, 3, round(avg(click+purchase+signup),6) FROM wide_a GROUP BY domain""",
)
def column_ablation_means(spark, sf):
    w = windows(spark, sf)
    cells = []
    for name, gone in ABLATIONS.items():
        kept = reshape.without(EVENT_METRICS, gone)
        total = sum((F.col(c) for c in kept[1:]), F.col(kept[0]))
        cells.append(F.struct(F.lit(name).alias("config"), F.lit(len(kept)).alias("n_kept"), F.round(F.avg(total), 6).alias("mean_sum")))
    return w.groupBy("domain").agg(F.array(*cells).alias("c")).select("domain", F.inline("c"))


@query(
    "clean_non_finite", "R11",
    sql_with("tall") + """
    SELECT event_id, round(CASE WHEN "Value" > 60 THEN "Value" ELSE 0 END, 6) AS x,
      CASE WHEN event_id % 3 <> 0 THEN 40.0::DOUBLE ELSE 0.0::DOUBLE END AS d FROM tall""",
)
def clean_non_finite(spark, sf):
    t = tall(spark, sf)
    x = F.when(F.col("Value") > 60, F.col("Value")).when(F.col("Value") > 30, F.lit(float("nan"))).when(
        F.col("Value") > 15, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    t = t.select("event_id", x.alias("x"), F.col("Duration").alias("d"))
    return reshape.clean_columns(t, ["x", "d"]).select("event_id", *r6("x"), "d")


@query(
    "limit_runs", "R12 J5",
    sql_with("tall", runs=f"SELECT file_source, row_number() OVER (ORDER BY {sql_order_key(42, 'file_source')}, file_source) AS rn "
             "FROM (SELECT DISTINCT file_source FROM tall)")
    + 'SELECT event_id, file_source, "Metric" FROM tall WHERE file_source IN (SELECT file_source FROM runs WHERE rn <= 10)',
)
def limit_runs(spark, sf):
    return reshape.sample_runs(tall(spark, sf), "file_source", 10, 42).select("event_id", "file_source", "Metric")


@query("drop_missing", "R13", sql_with("tall") + 'SELECT domain, count(*) AS n FROM tall WHERE "Duration" IS NOT NULL AND "Value" IS NOT NULL GROUP BY 1')
def drop_missing(spark, sf):
    return tall(spark, sf).dropna(subset=["Duration", "Value"]).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query(
    "schema_checks", "R14 R15 U2",
    sql_with("wide_a") + "SELECT CASE WHEN domain='mobile' THEN 1 ELSE 0 END AS mobility, defense_active, count(*) AS n FROM wide_a GROUP BY 1, 2",
)
def schema_checks(spark, sf):
    w = windows(spark, sf)
    reshape.require_columns(w, EVENT_METRICS)
    u = reshape.tag_union(w.where("domain = 'static'"), w.where("domain = 'mobile'"))
    return u.groupBy("mobility", "defense_active").agg(F.count(F.lit(1)).alias("n"))


@query(
    "profile_windows", "R16",
    sql_with("wide") + "SELECT domain, label, count(*) AS n_rows, count(DISTINCT run_id) AS n_runs FROM wide GROUP BY 1, 2",
)
def profile_windows(spark, sf):
    return reshape.profile(wide(spark, sf), ["domain"], "label", "run_id")


# ---- sources and sinks -------------------------------------------------------

@query(
    "scan_scenario_tree", "S1 S2 U1 D1 D2",
    sql_with("tall") + """
    SELECT scenario, CAST(file_source AS VARCHAR) AS file_source, defense_active, count(*) AS n_rows,
      count("Duration") AS n_durations, round(sum("Value"), 4) AS total
    FROM tall GROUP BY 1, 2, 3""",
)
def scan_scenario_tree(spark, sf):
    root = fresh_path(spark, "tree")
    sinks.write_tall(tall(spark, sf), root)
    return scans.scan_scenarios(spark, root).groupBy("scenario", "file_source", "defense_active").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("Duration").alias("n_durations"), F.round(F.sum("Value"), 4).alias("total")
    )


@query(
    "scan_file_report", "S1 R3",
    sql_with("tall", t="""SELECT scenario, file_source, file_source % 11 = 3 OR (file_source % 11 = 5 AND event_id % 3 = 0) AS bad FROM tall""",
             c="SELECT scenario, file_source, count(*) FILTER (NOT bad) AS n_rows, count(*) FILTER (bad) AS bad_rows FROM t GROUP BY 1, 2")
    + """SELECT scenario, CAST(file_source AS VARCHAR) AS file_source, n_rows, bad_rows,
      CASE WHEN bad_rows = 0 THEN 'read' WHEN n_rows = 0 THEN 'unusable' ELSE 'damaged' END AS state FROM c""",
)
def scan_file_report(spark, sf):
    """All window files are written, some with values that are no numbers, and reported file by file."""
    root = fresh_path(spark, "report")
    run = F.col("file_source") % 11
    bad = (run == 3) | ((run == 5) & (F.col("event_id") % 3 == 0))
    sinks.write_tall(tall(spark, sf).withColumn("Value", F.when(bad, F.concat(F.lit("lost "), "event_id")).otherwise(F.col("Value").cast("string"))), root)
    part = lambda name: F.regexp_extract("path", f"/{name}=([^/]+)/", 1).alias(name)
    return scans.file_report(spark, root).select(part("scenario"), part("file_source"), "n_rows", "bad_rows", "state")


@query(
    "scan_wide_bundle", "S3 K1",
    sql_with("wide_a") + f"SELECT domain, scenario, file_source, defense_active, {sql_r6(*EVENT_METRICS)} FROM wide_a",
)
def scan_wide_bundle(spark, sf):
    base = fresh_path(spark, "wide")
    sinks.write_wide(windows(spark, sf), base + ".parquet", EVENT_METRICS, META)
    return scans.scan_wide(spark, base).select(*META, *r6(*EVENT_METRICS))


@query(
    "scan_wide_gzip", "S3 K1",
    sql_with("wide_a") + "SELECT scenario, count(*) AS n, round(sum(click), 4) AS click FROM wide_a GROUP BY 1",
)
def scan_wide_gzip(spark, sf):
    base = fresh_path(spark, "wide")
    w = windows(spark, sf)
    sinks.write_wide(w, base + ".csv.gz", EVENT_METRICS, META, fmt="csv")
    schema = w.select(*sorted(EVENT_METRICS), *META).schema
    return scans.scan_wide(spark, base, schema).groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("click"), 4).alias("click"))


@query(
    "domain_from_path", "S4",
    sql_with("tall") + "SELECT event_id, domain FROM tall",
)
def domain_from_path(spark, sf):
    t = tall(spark, sf)
    return t.select("event_id", scans.domain_of_path(F.concat(F.lit("/data/Features_"), F.initcap("domain"), F.lit("/x.csv"))).alias("domain"))


LOG_CASE = """CASE WHEN regexp_matches(text, '(?i)copyright|licen[sc]e') THEN 'license'
      WHEN regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') THEN 'mail'
      WHEN regexp_matches(text, '(?i)api[_-]?key|secret|password|token') THEN 'secret' ELSE 'other' END"""


@query("classify_text_logs", "S5 D14", f"SELECT doc_id, {LOG_CASE} AS reason FROM documents")
def classify_text_logs(spark, sf):
    return scans.classify_logs(logs(spark, sf), "text", TEXT_RULES).select("doc_id", "reason")


@query(
    "reason_shares", "M15",
    f"""WITH c AS (SELECT {LOG_CASE} AS reason, count(*) AS n FROM documents GROUP BY 1),
    t AS (SELECT sum(n) AS s, sum(n) FILTER (reason='license') AS a, sum(n) FILTER (reason='mail') AS b FROM c)
    SELECT reason, n, round((100.0::DOUBLE*n/s)::DOUBLE, 6) AS pct, round((100.0::DOUBLE*a/b)::DOUBLE, 6) AS a_of_b_pct,
      round((100.0::DOUBLE*a/(a+b))::DOUBLE, 6) AS a_of_both_pct FROM c, t""",
)
def reason_shares(spark, sf):
    c = scans.classify_logs(logs(spark, sf), "text", TEXT_RULES)
    return scans.reason_counts(c, "reason", "license", "mail").select("reason", "n", *r6("pct", "a_of_b_pct", "a_of_both_pct"))


@query(
    "feature_list_text", "S6 D12",
    """WITH s AS (SELECT l_returnflag AS config, string_agg(DISTINCT p_brand, ';' ORDER BY p_brand) AS features
      FROM lineitem JOIN part ON l_partkey=p_partkey WHERE l_quantity > 25 GROUP BY 1),
    k AS (SELECT DISTINCT p_brand AS b FROM part WHERE p_size > 25)
    SELECT config, features, CAST(len(string_split(features, ';')) AS INTEGER) AS n_features,
      CAST((SELECT count(*) FROM (SELECT unnest(string_split(features, ';')) AS f) WHERE f NOT IN (SELECT b FROM k)) AS INTEGER) AS n_unknown
    FROM s""",
)
def feature_list_text(spark, sf):
    from windowlab.fixtures import table
    l, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    named = (
        l.where("l_quantity > 25").join(p.select("p_partkey", "p_brand"), l.l_partkey == p.p_partkey)
        .groupBy(F.col("l_returnflag").alias("config"))
        .agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ";").alias("features"))
    )
    known = p.where("p_size > 25").select(F.col("p_brand").alias("feature")).distinct()
    out = scans.feature_lists(named, "features", known, ["config"])
    return out.select("config", F.array_join("feature_list", ";").alias("features"), "n_features", F.size("unknown").cast("int").alias("n_unknown"))


@query(
    "incremental_cells", "K2",
    sql_with("seed_results") + "SELECT config, seed, direction, round(acc, 6) AS acc FROM seed_results",
)
def incremental_cells(spark, sf):
    path = fresh_path(spark, "cells")
    r = seed_results(spark, sf)
    sinks.save_cells(r.where("config <> 'R'"), path, ["config", "direction"])
    sinks.save_cells(r.where("config <> 'A'"), path, ["config", "direction"])  # N is written twice
    return spark.read.parquet(path).select("config", "seed", "direction", F.round("acc", 6).alias("acc"))


# ---- joins on probes and results ---------------------------------------------

@query(
    "probe_status_join", "J1 R13 D13",
    sql_with("probes", "statuses", s="SELECT seed, arg_min(result, pos) AS result FROM statuses GROUP BY seed")
    + """SELECT count(*) AS n_probes, sum(CASE WHEN result IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_unmatched,
      sum(CASE WHEN result='ACCEPT' THEN 1 ELSE 0 END)::BIGINT AS n_accept,
      sum(CASE WHEN result<>'ACCEPT' THEN 1 ELSE 0 END)::BIGINT AS n_reject FROM probes LEFT JOIN s USING (seed)""",
)
def probe_status_join(spark, sf):
    j = joins.left_join_first(probes(spark, sf), statuses(spark, sf), "seed", "pos", ["result"])
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    return j.agg(
        F.count(F.lit(1)).alias("n_probes"),
        flag(F.col("result").isNull())("n_unmatched"),
        flag(F.col("result") == "ACCEPT")("n_accept"),
        flag(F.col("result") != "ACCEPT")("n_reject"),
    )


@query(
    "accepted_effect_size", "X2 J1",
    sql_with("probes", "statuses", s="SELECT seed, arg_min(result, pos) AS result FROM statuses GROUP BY seed",
             j="SELECT result='ACCEPT' AS ok, balance, nation FROM probes JOIN s USING (seed)",
             m="""SELECT 'balance' AS feature, count(*) FILTER (ok) AS n1, count(*) FILTER (NOT ok) AS n0,
                 avg(balance) FILTER (ok) AS m1, avg(balance) FILTER (NOT ok) AS m0,
                 var_samp(balance) FILTER (ok) AS v1, var_samp(balance) FILTER (NOT ok) AS v0 FROM j
               UNION ALL SELECT 'nation', count(*) FILTER (ok), count(*) FILTER (NOT ok), avg(nation) FILTER (ok), avg(nation) FILTER (NOT ok),
                 var_samp(nation) FILTER (ok), var_samp(nation) FILTER (NOT ok) FROM j""")
    + "SELECT feature, n1 AS n_accept, n0 AS n_reject, round((m1-m0)/sqrt(((n0-1)*v0+(n1-1)*v1)/(n0+n1-2)), 6) AS d FROM m",
)
def accepted_effect_size(spark, sf):
    j = joins.left_join_first(probes(spark, sf), statuses(spark, sf), "seed", "pos", ["result"]).dropna(subset=["result"])
    j = j.withColumn("ok", F.col("result") == "ACCEPT")
    return stats.signed_d(j, ["balance", "nation"], "ok").withColumn("d", F.round("d", 6))


# ---- effect sizes on the tall windows ----------------------------------------

X1_SQL = dict(
    u="""SELECT domain, defense_active AS y, 'click' AS feature, click AS x FROM wide_a
       UNION ALL SELECT domain, defense_active, 'error', error FROM wide_a
       UNION ALL SELECT domain, defense_active, 'purchase', purchase FROM wide_a
       UNION ALL SELECT domain, defense_active, 'signup', signup FROM wide_a
       UNION ALL SELECT domain, defense_active, 'view', "view" FROM wide_a""",
    m="""SELECT domain, feature, count(*) FILTER (y=0) AS n0, count(*) FILTER (y=1) AS n1, avg(x) FILTER (y=0) AS m0, avg(x) FILTER (y=1) AS m1,
       var_samp(x) FILTER (y=0) AS v0, var_samp(x) FILTER (y=1) AS v1 FROM u GROUP BY 1, 2""",
    e="""SELECT domain, feature, CASE WHEN ((n0-1)*v0+(n1-1)*v1) = 0 THEN 0.0::DOUBLE
       ELSE round(abs(m1-m0)/sqrt(((n0-1)*v0+(n1-1)*v1)/(n0+n1-2)), 4) END AS d FROM m""",
    dd="""SELECT feature, max(d) FILTER (domain='static') AS static_d, max(d) FILTER (domain='mobile') AS mobile_d,
       round(max(d) FILTER (domain='mobile') - max(d) FILTER (domain='static'), 4) AS delta FROM e GROUP BY feature""",
)


@query("cohens_d_by_domain", "X1", sql_with("wide_a", **X1_SQL) + "SELECT feature, static_d, mobile_d, delta FROM dd")
def cohens_d_by_domain(spark, sf):
    return stats.cohens_d(windows(spark, sf), EVENT_METRICS, "defense_active", "domain").orderBy(F.desc("static_d"), "feature")


@query(
    "cohens_d_summary", "X3",
    sql_with("wide_a", **X1_SQL) + """SELECT grp, round(avg(static_d), 6) AS mean_static, round(avg(mobile_d), 6) AS mean_mobile,
      sum(CASE WHEN delta>0 THEN 1 ELSE 0 END)::BIGINT AS n_stronger, sum(CASE WHEN delta<0 THEN 1 ELSE 0 END)::BIGINT AS n_weaker
    FROM (SELECT *, 'all' AS grp FROM dd UNION ALL SELECT *, 'named' FROM dd WHERE regexp_matches(feature, '(?i)view|error')) GROUP BY grp""",
)
def cohens_d_summary(spark, sf):
    d = stats.cohens_d(windows(spark, sf), EVENT_METRICS, "defense_active", "domain")
    both = stats.d_summary(d).withColumn("grp", F.lit("all")).unionByName(
        stats.d_summary(d.where(F.col("feature").rlike("(?i)view|error"))).withColumn("grp", F.lit("named"))
    )
    return both.select("grp", *r6("mean_static", "mean_mobile"), "n_stronger", "n_weaker")


@query(
    "largest_shift_features", "N19 J6",
    sql_with("wide_a", **X1_SQL) + "SELECT feature, abs(delta) AS shift FROM dd WHERE feature NOT IN ('view') ORDER BY abs(delta) DESC, feature LIMIT 3",
)
def largest_shift_features(spark, sf):
    d = stats.cohens_d(windows(spark, sf), EVENT_METRICS, "defense_active", "domain")
    return joins.top_shift(d, "delta", ["view"], 3)

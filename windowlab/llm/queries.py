"""Registered queries of the operators; each is a thin use of its operator over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from windowlab.llm import bpe, chat, jaccard, lattice, repeats, resampling, rules, search, secrets, subwords, tiling, toxicity, warc
from windowlab.llm.store import new_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def encoded_digests(docs: DataFrame) -> DataFrame:
    """Digests of ids and decoded bytes of every document."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    whole = bpe.decode(bpe.encode(docs, path, pattern), path, pattern)
    return whole.select(
        F.col("id").alias("doc_id"), F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = rules.judge(docs, rules.fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", "quality.*")
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *[F.col(f"stats.{c}").alias(c) for c in base], "base_failed", "kept", F.col("rule").cast("bigint").alias("rule"))


@query
def op2_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], told.schema)
    read = chat.read_back(chat.format_turns(told.unionByName(trap)))
    return read.select(
        F.col("conv").alias("conv_id"), F.col("turns").alias("n_turns"), F.col("sha").alias("turns_sha256"), "loss_chars", F.col("loss_sha").alias("loss_sha256"), F.col("chars").alias("formatted_chars")
    )


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"))


@query
def op4_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lattice.part("doc_id", 7) == 2
    made = lattice.score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ~held_out)
    return made.select(
        F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), "train_tokens", F.col("base").alias("base_score"), "score"
    )


@query
def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    read = warc.read_archives(spark, folder)
    return read.select(F.col("id").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers").alias("refers_to"))


@query
def op6_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = lattice.part("doc_id", 5) != 0
    made = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn)
    return made.select(
        F.col("id").alias("doc_id"), (lattice.part("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("neighbours.example").alias("evidence")
    )


@query
def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), new_path(spark, "ledger"), "doc_id")
    return found.select(
        F.col("path").alias("doc_id"), *[secrets.number(F.col("spans"), k).alias(f"n_{k}") for k in secrets.BASE],
        F.sha2(secrets.label(F.col("spans"), secrets.BASE), 256).alias("base_sha256"), secrets.label(F.col("spans")).alias("spans"),
    )


@query
def op8_jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("class").alias("component_id"))


@query
def op9_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return done.select(F.col("id").alias("doc_id"), F.col("n").alias("n_bytes"), F.col("removed").alias("n_removed"), F.col("spans").alias("n_spans"), F.col("sha").alias("kept_sha256"))


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a test item that it holds."""
    pairs = tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "item_words", "covered_words", "tiles")


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return made.select(F.col("id").alias("doc_id"), F.col("features").alias("n_features"), "weight", "score", "rank")


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


@query
def op13_quality_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), lattice.part("doc_id", 4) == 2
    model = subwords.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    made = subwords.score(docs, model)
    return made.select(F.col("id").alias("doc_id"), (lattice.part("id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op11_importance_resampling"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM d) GROUP BY w),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM b) GROUP BY w),
codes AS (SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(0, 256)) AS i)),
spelt AS (SELECT w, list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT) AS s FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
bucket AS (SELECT w, xor(4294967295, list_reduce([4294967295] || s, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) % 10000 AS k FROM spelt, codes),
ds AS (SELECT k, sum(n)::BIGINT AS s FROM dw JOIN bucket USING (w) GROUP BY k),
bs AS (SELECT k, sum(n)::BIGINT AS t FROM bw JOIN bucket USING (w) GROUP BY k),
gain AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM ds) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM bs) + 10000)::DOUBLE)))::BIGINT AS g
  FROM ds FULL JOIN bs USING (k)),
numbered AS (SELECT row_number() OVER () AS r, doc_id, w FROM d),
weights AS (SELECT r, sum(g)::BIGINT AS weight FROM (SELECT r, unnest(w) AS w FROM numbered) JOIN bucket USING (w) JOIN gain USING (k) GROUP BY r),
scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT)::BIGINT AS score
  FROM numbered LEFT JOIN weights USING (r)),
ordered AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN place END AS rank FROM ordered
"""

ORACLES["op12_ranked_search"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '{search.TERM}') AS w FROM documents),
held AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT r, w, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY r, w),
df AS (SELECT w, count(*)::BIGINT AS df FROM tf GROUP BY w),
wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER}, '{search.TERM}')) AS w FROM benchmark),
weight AS (SELECT w, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM df, held),
size AS (SELECT r, doc_id, 50 + (50 * len(w) * n_docs) // n_terms AS m FROM d, held),
scored AS (SELECT item_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM wanted JOIN weight USING (w) JOIN tf USING (w) JOIN size USING (r) GROUP BY item_id, r),
placed AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored JOIN size USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= 50
"""

"""Cleaning pipeline over ``documents``: five stages, each written as Parquet and reread as the next one's input.

Every stage works on all rows that its predecessor kept; a row that stays keeps all its columns, whatever their names.  Empty and
null texts fail the quality rules.  A row without an id is addressed by a number made from its text, larger than any id, so it is
a copy like any other: it goes if a row with an id says the same, and if it holds a test item.  Of rows repeated with
their id and text one stays.  Empty tables pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from windowlab.llm import jaccard, rules, secrets, tiling
from windowlab.llm.queries import encoded_digests
from windowlab.llm.store import new_path, stored, table


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until it is no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def addressed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with an address that is never null, and its name: the id, or 2^62 and more from a hash of the text."""
    name = free_name(docs, "address")
    made = F.lit(1 << 62) + F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 61))
    return docs.withColumn(name, F.coalesce(F.col("doc_id").cast("bigint"), made)), name


def without(docs: DataFrame, name: str, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose column ``name`` is not among the rows of the one column of ``gone``."""
    other = free_name(docs, "gone")
    gone = gone.toDF(other)
    return docs.join(gone, docs[name] == gone[other], "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    return rules.kept(docs, rules.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the smallest id, once.

    Documents without words are linked with nothing and stay.
    """
    named, name = addressed(docs)
    classes = jaccard.classes(named.select(F.col(name).alias("doc_id"), "text")).select("id", "class")
    left = without(named, name, stored(classes.filter("class < id").select("id").distinct(), "copies"))
    # rows that say the same under the same address: only they are shuffled, and combined before
    mark = free_name(left, "mark")
    marked = left.withColumn(mark, F.xxhash64(name, F.coalesce("text", F.lit("")), F.col("text").isNull()))
    repeated = stored(marked.groupBy(mark).count().filter("count > 1").select(mark), "repeated")
    other = free_name(marked, "other")
    repeated = repeated.toDF(other)
    same = marked[mark] == repeated[other]
    one = marked.join(repeated, same, "left_semi").dropDuplicates([mark])
    return marked.join(repeated, same, "left_anti").unionByName(one).drop(mark, name)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    named, name = addressed(docs)
    found = tiling.contaminated(named.select(F.col(name).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(named, name, stored(found.select("id").distinct(), "contaminated")).drop(name)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by its kind in angle brackets; all documents stay."""
    place, spans, other = (free_name(docs, n) for n in ("place", "spans", "other"))
    key = docs.withColumn(place, F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob")))
    found = secrets.scan(docs.select("doc_id", "text"), new_path(spark, "ledger"), "doc_id").filter(F.size("spans") > 0)
    found = found.select(F.struct(F.col("path").alias("doc_id"), "blob").alias(other), F.col("spans").alias(spans)).dropDuplicates([other])
    joined = key.join(found, key[place].eqNullSafe(found[other]), "left")
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(secrets.masked(F.col("text"), F.col(spans)))
    return joined.withColumn("text", text).select(*[joined[c] if c != "text" else F.col("text") for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the bytes they decode to."""
    return encoded_digests(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality), ("jaccard_join", near_duplicates), ("decontamination", decontaminated), ("secret_scan", without_secrets), ("byte_bpe", encoded),
]

#: Learned rules and byte-level BPE are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

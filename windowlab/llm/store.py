"""Stored stages and small helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Bits of the bounded filter of ids that is sent to every task; more ids only let more rows through.
FILTER_BITS = 1 << 24

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; an own one only where it is unset and the session is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="shared-")
        _own[spark.sparkContext.applicationId] = named
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage ends here, and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extend(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` with more columns."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bit_filter(slots: DataFrame, bits: int) -> bytes:
    """A bit set of ``slots`` (column ``slot``, 0 to bits - 1): bounded by ``bits``, whatever the number of rows.

    Tasks use it to leave out rows before a shuffle; what it lets through by mistake later steps remove.
    """
    import numpy as np

    words = (
        slots.select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    )
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy().astype(np.int64)] = words["bits"].to_numpy()
    return out.tobytes()


def id_filter(ids: DataFrame, column: str, bits: int = FILTER_BITS) -> bytes:
    """A bit set of hashed ids; see ``filter_slot``."""
    return bit_filter(ids.select(filter_slot(column, bits).alias("slot")), bits)


def filter_slot(column: str, bits: int = FILTER_BITS):
    return F.pmod(F.xxhash64(F.col(column)), F.lit(bits))


def in_filter(slots, packed: bytes):
    """Which slots of an array are set."""
    import numpy as np

    words = np.frombuffer(packed, np.int64)
    return (words[slots >> 6] >> (slots & 63)) & 1 == 1


def join_sizes(df: DataFrame, sizes: DataFrame, key: str, count: str, how: str = "inner", most: int = 10_000) -> DataFrame:
    """``df`` joined to one row per key where a key may hold a third of ``df``.

    ``sizes`` has a row for each key and in ``count`` its rows in ``df``.  Keys above a ``most``-th part of all
    rows number at most ``most``: they are broadcast (bounded by the arithmetic) and their rows are not shuffled.
    The other keys are joined by a shuffle, in which none of them weighs much.
    """
    total = sizes.agg(F.sum(count)).first()[0] or 0
    limit = max(1000, total // most)
    hot = sizes.filter(F.col(count) > limit)
    names = [r[0] for r in hot.select(key).collect()]
    if not names:
        return df.join(sizes, key, how)
    is_hot = F.col(key).isin(names) & F.col(key).isNotNull()
    a = df.filter(is_hot).join(F.broadcast(hot), key, how)
    b = df.filter(~F.coalesce(is_hot, F.lit(False))).join(sizes.filter(F.col(count) <= limit), key, how)
    return a.unionByName(b)

"""Brute-force versions and small tables of awkward rows."""

import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def words(text, lower=True):
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return WORD.findall(text)


AWKWARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One two"), (6, "a b c a b c"), (7, "é漢字  x\r\ny"), (8, "tie tie tie tie"),
    (9, "word " * 30000), (10, "x" * 40000), (11, "line\nline\n\nline x"), (12, None), (5, "One two"),
]

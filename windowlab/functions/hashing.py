"""Randomness from hashes of keys.

``rand()`` depends on how rows are laid out over partitions.  Everything random
here is a function of (seed, key) only, so a retried task, another cluster size
or another engine gives the same draw.
"""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column, functions as F

# Modulus of the keyed polynomial hash: the prime 2^31 - 1, so that products of two residues fit a BIGINT.
PRIME = 2147483647


def order_key(seed, *cols) -> Column:
    """md5 text used to put keys in a random but reproducible order."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", seed.cast("string"), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]))


def hash_int(md5_text: Column) -> Column:
    """First 32 bits of an md5 text as BIGINT."""
    return F.conv(F.substring(md5_text, 1, 8), 16, 10).cast("bigint")


def uniform(md5_text: Column) -> Column:
    """Uniform double in [0, 1) from 52 bits of an md5 text."""
    return F.conv(F.substring(md5_text, 1, 13), 16, 10).cast("bigint") / F.lit(4503599627370496.0)


def key_code(*cols) -> Column:
    """Residue of a row key, the x of the polynomial hash; computed once per row."""
    return hash_int(order_key("code", *cols)) % F.lit(PRIME)


def second_code(*cols) -> Column:
    """Another residue of the same key, independent of the first: together they tell 10^18 keys apart."""
    return hash_int(order_key("second", *cols)) % F.lit(PRIME)


def replicate_coefficients(seed: int, n: int) -> list[tuple[int, int, int, int, int]]:
    """(replicate, a, b, c, d) for replicates 0..n-1, from md5 of (seed, replicate)."""
    out = []
    for r in range(n):
        h = hashlib.md5(f"{seed}|{r}".encode()).hexdigest()
        a, b, c, d = (int(h[i : i + 8], 16) % PRIME for i in (0, 8, 16, 24))
        out.append((r, a, b, c, d))
    return out


def replicate_axis(seed: int, n: int) -> Column:
    """The replicate axis as one constant array column, to be exploded next to the data.

    It is a folded literal: no join and no shuffle is needed to give every row its replicates.
    """
    rows = [dict(rep=r, a=a, b=b, c=c, d=d) for r, a, b, c, d in replicate_coefficients(seed, n)]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<rep:int,a:bigint,b:bigint,c:bigint,d:bigint>>")


def poly_hash(x: Column, y: Column, r: Column) -> Column:
    """((a x + b) x + c + d y) mod p: a pseudo-random integer in [0, p) per (row, replicate)."""
    first = (((r["a"] * x + r["b"]) % F.lit(PRIME)) * x + r["c"]) % F.lit(PRIME)
    return (first + r["d"] * y) % F.lit(PRIME)


def poisson_cuts() -> list[int]:
    """Integer cut points of the Poisson(1) distribution on [0, p)."""
    cuts, cdf, term = [], 0.0, math.exp(-1.0)
    for k in range(12):
        cdf += term
        cuts.append(int(cdf * PRIME))
        term /= k + 1
    return [c for c in cuts if c < PRIME]


def poisson_weight(u: Column) -> Column:
    """Number of times a unit is drawn: Poisson(1), the large-n limit of drawing with replacement."""
    w = F.lit(0)
    for cut in poisson_cuts():
        w = w + (u >= F.lit(cut)).cast("int")
    return w


# The same functions as DuckDB text, for the oracle queries.

def sql_order_key(seed, *cols: str) -> str:
    parts = ", ".join([f"'{seed}'" if not str(seed).startswith("@") else str(seed)[1:]] + [f"CAST({c} AS VARCHAR)" for c in cols])
    return f"md5(concat_ws('|', {parts}))"


def sql_hash_int(md5_text: str) -> str:
    return f"CAST(('0x' || substr({md5_text}, 1, 8)) AS BIGINT)"


def sql_uniform(md5_text: str) -> str:
    return f"(CAST(('0x' || substr({md5_text}, 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def sql_key_code(*cols: str) -> str:
    """Both codes of a key, as columns x and y."""
    return ", ".join(f"({sql_hash_int(sql_order_key(tag, *cols))} % {PRIME}) AS {c}" for tag, c in (("code", "x"), ("second", "y")))


def sql_replicates(seed: int, n: int) -> str:
    def part(i: int) -> str:
        return f"CAST(('0x' || substr(md5('{seed}|' || range), {i}, 8)) AS BIGINT) % {PRIME}"

    return f"SELECT CAST(range AS INTEGER) AS rep, {part(1)} AS a, {part(9)} AS b, {part(17)} AS c, {part(25)} AS d FROM range({n})"


def sql_poly_hash() -> str:
    return f"((((((a * x + b) % {PRIME}) * x + c) % {PRIME}) + d * y) % {PRIME})"


def sql_poisson(u: str) -> str:
    return "(" + " + ".join(f"CAST({u} >= {c} AS INTEGER)" for c in poisson_cuts()) + ")"

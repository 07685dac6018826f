"""Uniform draws that are functions of their key, so retries and other engines repeat them."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(tag: str, *key) -> Column:
    """A number in [0, 1) from 52 bits of md5('tag|key|...')."""
    parts = [F.lit(tag), *(k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def uniform_py(tag: str, *key) -> float:
    return (int.from_bytes(md5("|".join([tag, *map(str, key)]).encode()).digest()[:7], "big") >> 4) / 2**52

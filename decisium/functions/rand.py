"""Keyed, reproducible randomness: md5 of seed and key, the same in any engine."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 4294967296.0
_salt: ContextVar[str] = ContextVar("salt", default="")


@contextlib.contextmanager
def seeded(salt: str) -> Iterator[None]:
    """Draws of plans that are made inside have `salt` before their seeds."""
    token = _salt.set(_salt.get() + salt)
    try:
        yield
    finally:
        _salt.reset(token)


def hash32(seed: str, *key: Column | str) -> Column:
    """A whole number from 0 to 2**32 - 1."""
    parts = [F.col(k) if isinstance(k, str) else k for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(_salt.get() + seed), *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def uniform(seed: str, *key: Column | str) -> Column:
    """A number in [0, 1)."""
    return hash32(seed, *key) / F.lit(SPAN)


def hash32_sql(seed: str, *key: str) -> str:
    return f"('0x' || substr(md5('{seed}|' || {" || '|' || ".join(f'({k})::VARCHAR' for k in key)}), 1, 8))::BIGINT"


def uniform_sql(seed: str, *key: str) -> str:
    return f"({hash32_sql(seed, *key)} / {SPAN})"

"""Keyed, reproducible values.

Every synthetic value is a function of (seed, purpose, normalised original), never of
``rand()``; the integer form uses the first 15 hex digits of SHA-256 so that any SQL
engine can recompute it.
"""

from __future__ import annotations

from .sql import Sql, fn, lit, sql


#: Key used when the caller gives no seed.
DEFAULT_SEED = "default"


def seed_text(seed: int | str | None) -> str:
    return DEFAULT_SEED if seed is None else str(seed)


def _part(value: Sql | str | int) -> Sql:
    return value if isinstance(value, Sql) else lit(str(value))


def keyed_hex(seed: int | str | None, purpose: str, *values: Sql | str) -> Sql:
    parts = [_part(seed_text(seed)), _part(purpose), *map(_part, values)]
    return fn.sha2(fn.concat_ws("|", *parts), 256)


def hex_to_int(digits: Sql) -> Sql:
    return fn.conv(fn.substring(digits, 1, 15), 16, 10).cast("bigint")


def keyed_int(
    seed: int | str | None, purpose: str, size: Sql | int, *values: Sql | str
) -> Sql:
    """Uniform integer in ``[0, size)`` chosen by the key."""
    size = sql(size)
    return fn.pmod(hex_to_int(keyed_hex(seed, purpose, *values)), size.cast("bigint"))


def content_hash(text: Sql) -> Sql:
    """Base64 MD5 of a text, the content key carried by parsed documents."""
    return fn.base64(fn.unhex(fn.md5(text)))

"""Reversible tokens ``[LABEL_suffix]``: one per (seed, label, original)."""

from __future__ import annotations


from .hashing import keyed_hex
from .sql import Sql, fn

#: Names that a label may have, so that its tokens are found again in a text.
LABEL_REGEX = r"[A-Za-z0-9_][A-Za-z0-9_.:-]*"
#: Shape of a token inside a text.
TOKEN_REGEX = rf"\[{LABEL_REGEX}_[0-9a-f]{{8,64}}\]"


def token(
    label: Sql, text: Sql, seed: int | str | None = None, width: int = 16
) -> Sql:
    digest = keyed_hex(seed, "token", label, text)
    return fn.concat(
        "[", label, "_", fn.substring(digest, 1, width), "]"
    )

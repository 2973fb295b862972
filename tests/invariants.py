"""Checks that hold for every redaction, on collected rows."""

from __future__ import annotations

import re

TOKEN = re.compile(r"\[[A-Za-z0-9_]+_[0-9a-f]{8,64}\]")


def check_spans(text: str, spans) -> None:
    last = 0
    for s in sorted(spans, key=lambda s: s.start):
        assert 0 <= s.start < s.end <= len(text)
        assert text[s.start : s.end] == s.text
        assert s.start >= last
        last = s.end


def reconstructed(redacted: str, spans) -> str:
    for s in sorted(spans, key=lambda s: -s.new_start):
        assert redacted[s.new_start : s.new_end] == s.new_text
        redacted = redacted[: s.new_start] + s.text + redacted[s.new_end :]
    return redacted


def check_redaction(text: str, redacted: str, spans) -> None:
    check_spans(text, spans)
    assert reconstructed(redacted, spans) == text

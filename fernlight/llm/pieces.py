"""Splits a text into the matches of the byte-level BPE pattern."""

from __future__ import annotations

import re

import public_tokenizers
import regex

_GENERAL = regex.compile(public_tokenizers.PATTERN)
# Within Latin-1 the classes of the pattern are short enough for the plain engine's bitmaps.
_L = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
_N = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
_S = "\\t-\\r \\x85\\xa0"
_LATIN = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def split(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _GENERAL.findall(text)
    return _LATIN.findall(text)

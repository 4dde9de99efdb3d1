"""Whitespace, prefix and marker handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as whitespace, as a regex class both Java and RE2 read the same way.
#: ``\s`` alone is ASCII only, and a no-break space between mark and number is common.
SPACE = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

_SPACE_RANGES = (
    (0x09, 0x0D),
    (0x1C, 0x20),
    (0x85, 0x85),
    (0xA0, 0xA0),
    (0x1680, 0x1680),
    (0x2000, 0x200A),
    (0x2028, 0x2029),
    (0x202F, 0x202F),
    (0x205F, 0x205F),
    (0x3000, 0x3000),
)
SPACE_CHARS = "".join(chr(c) for lo, hi in _SPACE_RANGES for c in range(lo, hi + 1))


def strip(text: Column) -> Column:
    """Both ends freed of whitespace. Plain ``trim`` would only take U+0020."""
    return F.trim(text, F.lit(SPACE_CHARS))


def strip_prompt(raw: Column, prompt: Column) -> Column:
    """Decoded text without the prompt it starts with; other text is left whole."""
    rest = F.when(raw.startswith(prompt), F.substr(raw, F.length(prompt) + 1)).otherwise(raw)
    return strip(rest)


def strip_marker(text: Column, marker: str) -> Column:
    return strip(F.replace(text, F.lit(marker), F.lit("")))


def head_chars(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def error_text(completion: Column, error: Column, mark: str) -> Column:
    """The completion, or ``mark`` plus the message where the call failed."""
    return F.coalesce(completion, F.concat(F.lit(mark + " "), error))


def is_error(text: Column, mark: str) -> Column:
    return text.startswith(mark)

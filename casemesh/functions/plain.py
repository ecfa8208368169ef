"""Column helpers on plain characters: white space and full-width forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The full-width forms of the printable ASCII signs, and those signs.
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
ASCII_SIGNS = "".join(chr(c) for c in range(0x21, 0x7F))
#: Every character that Unicode counts as white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"


def ascii_width(c: Column) -> Column:
    """Full-width ASCII signs as ASCII, all else as it is."""
    return F.translate(c, FULL_WIDTH, ASCII_SIGNS)


def squeezed(c: Column) -> Column:
    """Without any white space and with full-width signs as ASCII, in one pass over the text."""
    return F.translate(c, FULL_WIDTH + WHITE, ASCII_SIGNS)


def stripped(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, f"^[{WHITE}]+|[{WHITE}]+$", "")


def month_of(c: Column) -> Column:
    """yyyy-MM of a timestamp, whatever the session's time zone."""
    return F.substring(c.cast("string"), 1, 7)

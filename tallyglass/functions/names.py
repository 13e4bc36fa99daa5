"""Canonical spellings of image names and digests, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space that ``plain_*`` removes at both ends.
BLANKS = " \t\n\r\u000b\u000c\u0085    　﻿"


def strip(col: Column | str) -> Column:
    """``col`` without white space at either end; null stays null."""
    return F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(BLANKS))


def plain_name(col: Column | str) -> Column:
    """White space removed, the last component after ``/`` or a backslash, lower case; null stays null."""
    return F.lower(F.substring_index(F.translate(strip(col), "\\", "/"), "/", -1))


def plain_digest(col: Column | str) -> Column:
    """Trimmed, lower case, without a leading ``sha256:``; null stays null."""
    low = F.lower(strip(col))
    return F.when(low.startswith("sha256:"), F.substring(low, 8, 1 << 20)).otherwise(low)


def plain_side(col: Column | str) -> Column:
    """A split label trimmed and in lower case; null stays null."""
    return F.lower(strip(col))

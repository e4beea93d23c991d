"""Kernel-log (dmesg) line parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.functions.basics import as_col, found, trim_space
from emberline.functions.timestamps import dmesg_stamp


def dmesg_header(line) -> Column:
    """Text between the stamp and the first colon, NULL when absent or empty."""
    text = as_col(line)
    return F.when(dmesg_stamp(text).isNotNull(), found(text, r"^\[[^\]]*\] *([^:]*):", 1))


def headers_related(a, b) -> Column:
    """Equal after trimming, or one a prefix of the other (``ata1`` and ``ata1.00``)."""
    left, right = trim_space(as_col(a)), trim_space(as_col(b))
    return (
        (left != "") & (right != "") & (F.startswith(left, right) | F.startswith(right, left))
    )


def strip_dmesg_timestamp(line) -> Column:
    text = as_col(line)
    rest = trim_space(F.regexp_extract(text, r"(?s)^\[[^\]]*\](.*)$", 1))
    return F.when(dmesg_stamp(text).isNotNull(), rest).otherwise(text)

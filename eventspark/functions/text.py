"""Text predicates with Java semantics, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the event contract: the allowed symbol characters and the
# UUID group widths (8-4-4-4-12 hex digits; shorter groups are accepted and
# padded, longer text than 36 characters is not).
SYMBOL_CHARS = "A-Za-z0-9._-"
UUID_GROUP_WIDTHS = (8, 4, 4, 4, 12)
UUID_MAX_LENGTH = 36

_SYMBOL_RE = r"\A[" + SYMBOL_CHARS + r"]+\z"
_UUID_RE = r"\A" + "-".join(f"[0-9a-fA-F]{{1,{w}}}" for w in UUID_GROUP_WIDTHS) + r"\z"
# Java's String.trim() removes every char up to U+0020, not just blanks.
_JAVA_BLANK_RE = r"\A[\x00-\x20]*\z"


def is_blank(c: Column) -> Column:
    """NULL or only characters <= U+0020 (Java ``trim().isEmpty()``)."""
    return c.isNull() | c.rlike(_JAVA_BLANK_RE)


_JAVA_TRIM_CHARS = "".join(chr(i) for i in range(0x21))


def java_trim(c: Column) -> Column:
    """Java ``String.trim()``: strip every char <= U+0020 from both ends."""
    return F.btrim(c, F.lit(_JAVA_TRIM_CHARS))


def matches_symbol(c: Column) -> Column:
    """Whole-string match; ``\\z`` so that a trailing newline does not pass."""
    return F.coalesce(c.rlike(_SYMBOL_RE), F.lit(False))


def is_uuid_text(c: Column) -> Column:
    return F.coalesce(c.rlike(_UUID_RE) & (F.length(c) <= UUID_MAX_LENGTH), F.lit(False))


def canonical_uuid(c: Column) -> Column:
    """Lower-case 8-4-4-4-12 form of a text accepted by ``is_uuid_text``. A
    36-character accepted text already has full groups: only the case changes."""
    parts = F.split(F.lower(c), "-")
    padded = F.concat_ws("-", *[F.lpad(F.get(parts, i), w, "0") for i, w in enumerate(UUID_GROUP_WIDTHS)])
    return F.when(F.length(c) == UUID_MAX_LENGTH, F.lower(c)).otherwise(padded)

"""Column functions that Spark doesn't have under one name."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts read as moments: RFC 3339 with an offset or Z, and three forms without one.
MOMENT = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?)?$"


def moment(text: Column) -> Column:
    """Text as timestamp without zone, offsets taken to UTC; NULL for any other text.

    What has no offset is read as it stands, so the session's zone doesn't matter.
    """
    plain = F.regexp_replace(text, r"(Z|[+-]\d{2}:\d{2})$", "")
    at = plain.try_cast("timestamp_ntz")
    sign = F.when(text.rlike(r"[+]\d{2}:\d{2}$"), -1).when(text.rlike(r"T.*-\d{2}:\d{2}$|:\d{2}-\d{2}:\d{2}$"), 1)
    minutes = F.substring(text, -5, 2).try_cast("int") * 60 + F.substring(text, -2, 2).try_cast("int")
    shifted = at + F.make_dt_interval(F.lit(0), F.lit(0), sign * minutes, F.lit(0))
    return F.when(text.rlike(MOMENT), F.when(sign.isNotNull(), shifted).otherwise(at))


def parse_moment(text: str) -> datetime | None:
    """The same of a literal."""
    if not re.match(MOMENT, text):
        return None
    try:
        found = datetime.fromisoformat(text)
    except ValueError:
        return None
    return found.astimezone(timezone.utc).replace(tzinfo=None) if found.tzinfo else found


def number_text(c: Column, fractional: bool) -> Column:
    """A number as text: without exponent, without trailing zeros."""
    return F.regexp_replace(F.call_function("format_number", c, F.lit("0.####################")), ",", "") if fractional else c.cast("string")


def trim(c: Column, start: bool = True, end: bool = True) -> Column:
    """Without white space of any script at the ends; of NULL, ''."""
    ends = [r"^\s+"] * start + [r"\s+$"] * end
    return F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)" + "|".join(ends), "")


def index_of(c: Column, what: Column) -> Column:
    """0-based place of the first occurrence, case folded; -1 if there is none."""
    return F.coalesce(F.instr(F.lower(c), F.lower(what)) - 1, F.lit(-1))


def subsequence(c: Column, letters: str) -> Column:
    """Whether the letters occur in this order, case folded."""
    return F.lower(c).rlike("(?s)" + ".*".join(re.escape(x) for x in letters.lower()))


def fuzzy_score(c: Column, letters: str) -> Column:
    """0 without a match; else 16 a letter, 8 more for each that follows the one before at once.

    The shortest stretch that holds the letters in order decides, so that closer matches score more.
    """
    low = F.lower(c)
    whole = F.lit(letters.lower())
    n = len(letters)
    stretch = F.regexp_extract(low, "(?s)" + ".*?".join(re.escape(x) for x in letters.lower()), 0)
    gaps = F.length(stretch) - n
    return F.when(~subsequence(c, letters), F.lit(0)).when(low.contains(whole), F.lit(16 * n + 8 * (n - 1))).otherwise(F.greatest(F.lit(16 * n) - gaps, F.lit(1)))

"""String column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_pattern(text: str) -> str:
    """A regular expression that matches ``text`` itself."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", text)


def literal_replacement(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def normalise(value: Column, trim: str = "both", case: str = "none") -> Column:
    """Trim (both, left, right, none) and change case (upper, lower, title, none)."""
    trims = {"both": F.trim, "left": F.ltrim, "right": F.rtrim, "none": lambda c: c}
    cases = {"upper": F.upper, "lower": F.lower, "title": F.initcap, "none": lambda c: c}
    return cases[case](trims[trim](value))


def replace_text(
    value: Column, search: str, replacement: str = "", regex: bool = False, case_sensitive: bool = False
) -> Column:
    """Replace every occurrence; plain text unless ``regex``."""
    if not regex and case_sensitive:
        return F.replace(value, F.lit(search), F.lit(replacement))
    pattern = search if regex else literal_pattern(search)
    target = replacement if regex else literal_replacement(replacement)
    return F.regexp_replace(value, pattern if case_sensitive else f"(?i){pattern}", target)


def join_text(values: list[Column], separator: str = "", enclosure: str = "") -> Column:
    """Concatenate; a NULL counts as empty text."""
    parts = [
        F.concat(F.lit(enclosure), F.coalesce(v.cast("string"), F.lit("")), F.lit(enclosure)) for v in values
    ]
    return F.concat_ws(separator, *parts)


# Fixed value: what counts as an e-mail address.
EMAIL = r"^[\p{L}\p{N}_.+\-]+@[\p{L}\p{N}_\-]+\.[\p{L}\p{N}_]{2,}$"


def is_email(value: Column) -> Column:
    return F.trim(value).rlike(EMAIL)


def email_or_null(value: Column) -> Column:
    """The value where it is a valid address, NULL otherwise."""
    return F.when(is_email(value), value)

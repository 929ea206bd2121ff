"""Format-preserving masking: separators and length stay, content goes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIDDEN = "***"

# Words in a format hint that select a mask, tried in this order.
PHONE_HINTS = ("phone", "tel", "celular", "móvil", "movil")
DATE_HINTS = ("date", "fecha", "yyyy", "dd/mm", "mm/dd", "iso 8601")
# Hints whose format is worth an example, and the fewest distinct values for one.
EXAMPLE_HINTS = (
    "email", "phone", "tel", "celular", "fecha", "date", "yyyy", "document", "alphanumeric", "numeric id",
)
MIN_DISTINCT_FOR_EXAMPLES = 10


def mask_email(value: Column) -> Column:
    """``john@corp.com`` becomes ``j***@***.com``."""
    local = F.substring_index(value, "@", 1)
    domain = F.substr(value, F.length(local) + 2)
    name = F.substring_index(domain, ".", -1)
    before = F.length(domain) - F.length(name) - 1
    hidden = F.when(
        F.instr(domain, ".") > 0,
        F.concat(F.repeat(F.lit("*"), F.least(F.lit(3), before)), F.lit("."), name),
    ).otherwise(F.lit(HIDDEN))
    return F.when(F.instr(value, "@") == 0, F.lit("***@***.***")).otherwise(
        F.concat(F.substring(local, 1, 1), F.lit(HIDDEN), F.lit("@"), hidden)
    )


def mask_phone(value: Column) -> Column:
    return F.regexp_replace(value, r"\p{Nd}", "*")


def mask_date(value: Column) -> Column:
    return F.regexp_replace(value, r"\p{Nd}", "X")


def mask_generic(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"\p{Nd}", "*"), r"\p{L}", "X")


def _mentions(hint: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(hint, F.lit(word))
    return found


def mask_value(value: Column, hint: Column) -> Column:
    """Mask by format hint; without a value or a hint nothing of the value is shown."""
    text, kind = value.cast("string"), F.lower(hint)
    blank = text.isNull() | (text == "") | kind.isNull() | (kind == "")
    return (
        F.when(blank, F.lit(HIDDEN))
        .when(F.contains(kind, F.lit("email")), mask_email(text))
        .when(_mentions(kind, PHONE_HINTS), mask_phone(text))
        .when(_mentions(kind, DATE_HINTS), mask_date(text))
        .otherwise(mask_generic(text))
    )


def shows_examples(hint: Column, distinct: Column) -> Column:
    """True when masked examples help and cannot reveal a short value list."""
    return F.coalesce(
        (distinct >= MIN_DISTINCT_FOR_EXAMPLES) & _mentions(F.lower(hint), EXAMPLE_HINTS), F.lit(False)
    )

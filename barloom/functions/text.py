"""Column functions over free text: corporate-action subjects, tickers, filing tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns the classification depends on.
SPLIT_WORDS = ("split", "sub-division", "sub division", "subdivision", "consolidation")
AMOUNT = r"(?i)(?:rs|re)\.?\s*([0-9]+(?:\.[0-9]+)?)"
FACE_VALUES = (
    r"(?is)(?:rs|re)\.?\s*([0-9]+(?:\.[0-9]+)?)\D+?to\b\D*?(?:rs|re)\.?\s*([0-9]+(?:\.[0-9]+)?)"
)
RATIO = r"(\d+)\s*:\s*(\d+)"
PERCENT = r"([0-9]+(?:\.[0-9]+)?)\s*%"
ACTION_RATIOS = {"split": 0.5, "bonus": 0.5, "dividend": 1.0}


def action_ratio(kind: Column) -> Column:
    """Price multiplier the fixture events carry by type."""
    return F.when(kind == "dividend", ACTION_RATIOS["dividend"]).otherwise(ACTION_RATIOS["split"])


def number_at(text: Column, pattern: str, group: int = 1) -> Column:
    """Captured number, null when the pattern does not occur."""
    return F.regexp_extract(text, pattern, group).try_cast("double")


def classify_action(subject: Column) -> Column:
    """split / bonus / dividend, or null.  Explicit split words win over a dividend."""
    low = F.lower(subject)
    has_split = low.rlike("|".join(SPLIT_WORDS))
    has_bonus = F.contains(low, F.lit("bonus"))
    face_change = F.contains(low, F.lit("face value")) & subject.rlike(FACE_VALUES)
    return (
        F.when(has_split, "split")
        .when(F.contains(low, F.lit("dividend")), F.when(has_bonus, "bonus").otherwise("dividend"))
        .when(face_change, "split")
        .when(has_bonus, "bonus")
    )


def split_multiplier(subject: Column) -> Column:
    """new/old face value, else a/b of an a:b ratio; null when neither is positive."""
    old, new = number_at(subject, FACE_VALUES, 1), number_at(subject, FACE_VALUES, 2)
    a, b = number_at(subject, RATIO, 1), number_at(subject, RATIO, 2)
    return F.coalesce(
        F.when((old > 0) & (new > 0), new / old),
        F.when((a > 0) & (b > 0), a / b),
    )


def bonus_multiplier(subject: Column) -> Column:
    """b/(a+b) of a bonus a:b."""
    a, b = number_at(subject, RATIO, 1), number_at(subject, RATIO, 2)
    return F.when((a >= 0) & (b > 0), b / (a + b))


def dividend_amount(subject: Column, face_value: Column) -> Column:
    """Sum, over the 'dividend' words, of the first amount after each; else % of face value.

    The search for a word's amount runs to the end of the text, so a word without an
    amount of its own takes the next word's: each piece is rejoined with its tail.
    """
    pieces = F.split(subject, "(?i)dividend")
    tails = F.transform(
        F.sequence(F.lit(2), F.size(pieces)),
        lambda k: F.regexp_extract(
            F.array_join(F.slice(pieces, k, F.size(pieces)), " "), AMOUNT, 1
        ).try_cast("double"),
    )
    amounts = F.when(F.size(pieces) > 1, F.array_compact(tails))
    total = F.when(
        F.size(amounts) > 0, F.aggregate(amounts, F.lit(0.0), lambda acc, x: acc + x)
    )
    share = number_at(subject, PERCENT)
    return F.coalesce(total, F.when(face_value > 0, share / 100.0 * face_value))


def normalise_ticker(symbol: Column, renames: dict[str, str], suffix: str = ".NS") -> Column:
    """Trimmed upper-case ticker with an exchange suffix; index tickers pass through."""
    clean = F.upper(F.trim(symbol))
    mapped = clean
    if renames:
        table = F.create_map(*[F.lit(x) for kv in sorted(renames.items()) for x in kv])
        mapped = F.coalesce(F.try_element_at(table, clean), clean)
    done = clean.startswith("^") | clean.endswith(suffix)
    return F.when(done, clean).otherwise(F.concat(mapped, F.lit(suffix)))


# Fixed value: namespace prefix of the standard filing tags.
TAG_PREFIX = "in-bse-fin"


def tag_pattern(tag: str) -> str:
    name = f"{TAG_PREFIX}:{tag}"
    return rf"<{name}\b[^>]*>\s*(-?\d[\d,]*\.?\d*(?:[eE][+-]?\d+)?)\s*</{name}>"


def _plain_number(s: Column) -> Column:
    return F.replace(s, F.lit(","), F.lit("")).try_cast("double")


def first_tag_number(text: Column, tags: Sequence[str]) -> Column:
    """First number of the first tag, in priority order, that has one."""
    return F.coalesce(*[_plain_number(F.regexp_extract(text, tag_pattern(t), 1)) for t in tags])


def first_positive_tag_number(text: Column, tags: Sequence[str]) -> Column:
    """As :func:`first_tag_number`, over every occurrence, keeping the first value above zero."""
    hits = []
    for t in tags:
        values = F.transform(F.regexp_extract_all(text, F.lit(tag_pattern(t)), F.lit(1)), _plain_number)
        hits.append(F.try_element_at(F.filter(values, lambda v: v > 0), F.lit(1)))
    return F.coalesce(*hits)


def safe_double(value: Column, default: float | None = None) -> Column:
    """Numeric value, or the default for anything missing, NaN or infinite."""
    number = value.try_cast("double")
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
    return F.when(bad, F.lit(default).cast("double")).otherwise(number)


def safe_long(value: Column, default: int | None = None) -> Column:
    number = safe_double(value)
    return F.when(number.isNull(), F.lit(default).cast("long")).otherwise(number.cast("long"))


def safe_bool(value: Column, default: bool = False) -> Column:
    return F.coalesce(value.try_cast("boolean"), F.lit(default))

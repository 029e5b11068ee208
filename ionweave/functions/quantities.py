"""Times written as text: number formats, units and durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds per unit.
FACTORS = {"s": 1.0, "min": 60.0, "ms": 0.001, "h": 3600.0}
#: Spellings of each unit, as regular expressions over lower case text.
SPELLINGS = {
    "ms": r"ms|msecs?|milliseconds?|millisekunden?|millisecondes?|milisegundos?|millisecondi",
    "s": r"s|secs?|seconds?|sek|sekunden?|secondes?|segundos?|secondi|secondo|seconden|\"|''|″",
    "min": r"min|mins|minutes?|minuten?|minutos?|minuti|minuto|minuty|m|'|′",
    "h": r"h|hrs?|hours?|std|stunden?|heures?|horas?|ore|ora|uren|uur",
}
_NUMBER = r"[+-]?[0-9](?:[0-9.,'\u00a0\u202f ]*[0-9])?(?:[eE][+-]?[0-9]+)?"
_ANY_UNIT = "|".join(SPELLINGS.values())
#: What a note must name to be about retention times.
_ABOUT = r"\brt\b|retention|rétention|retención|retenção|ritenzione|retentie|\bzeiten\b|retencji|удержив"


def with_number(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: the number in a text with decimal point or comma and any thousands separator; null where it is none.

    Built in steps, so that each is evaluated once however often the next one refers to it.
    """
    t, dot, comma = F.col("_t"), F.instr(F.reverse("_t"), "."), F.instr(F.reverse("_t"), ",")
    df = df.withColumn("_t", F.regexp_replace(text, r"[\u00a0\u202f ']", ""))
    plain = (
        F.when((dot > 0) & (comma > 0) & (comma < dot), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when((dot > 0) & (comma > 0), F.replace(t, F.lit(","), F.lit("")))
        .when(t.rlike(r"\A[+-]?[0-9]{1,3}(?:\.[0-9]{3}){2,}\z"), F.replace(t, F.lit("."), F.lit("")))
        .when(t.rlike(r"\A[+-]?[0-9]{1,3}(?:,[0-9]{3}){2,}\z"), F.replace(t, F.lit(","), F.lit("")))
        .otherwise(F.replace(t, F.lit(","), F.lit(".")))
    )
    return df.withColumn("_p", plain).withColumn(name, F.col("_p").try_cast("double")).drop("_t", "_p")


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.coalesce(F.replace(F.regexp_extract(text, pattern, group), F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))


def unit_of(word: Column) -> Column:
    """The code of a unit word in lower case."""
    out = F.lit(None).cast("string")
    for code, spellings in reversed(SPELLINGS.items()):
        out = F.when(word.rlike(rf"\A(?:{spellings})\z"), code).otherwise(out)
    return out


def seconds_of(value: Column, unit: Column) -> Column:
    factor = F.lit(None).cast("double")
    for code, seconds in FACTORS.items():
        factor = F.when(unit == code, seconds).otherwise(factor)
    return value * factor


def parse_times(df: DataFrame, text: str) -> DataFrame:
    """Adds ``value, unit, seconds``: the number as written, its unit if the text has one, and the seconds if that is known.

    ``unit`` is ``clock`` for durations (``00:14:39.66``, ``16:44.76``, ``PT18M7.74S``), whose value is null; null for a
    bare number; a text without a number has all null.
    """
    iso = r"(?i)\APT(?=.*[0-9])(?:([0-9]+(?:[.,][0-9]+)?)H)?(?:([0-9]+(?:[.,][0-9]+)?)M)?(?:([0-9]+(?:[.,][0-9]+)?)S)?\z"
    colon = r"\A(?:([0-9]+):)?([0-9]+):([0-9]{1,2}(?:[.,][0-9]+)?)\z"
    plain = rf"(?i)\A({_NUMBER})\s*({_ANY_UNIT})?\.?\z"
    x = df.withColumn("_x", F.regexp_replace(F.trim(text), r"(?i)\A(?:rt|t)\s*[=:]\s*", ""))
    x = x.withColumn("_clock", F.when(F.col("_x").startswith("P") | F.col("_x").startswith("p"), F.when(F.col("_x").rlike(iso), "iso")).when(F.col("_x").contains(":"), F.when(F.col("_x").rlike(colon), "colon")))
    pattern = {"iso": iso, "colon": colon}
    clock = F.lit(None).cast("double")
    for kind, p in pattern.items():
        clock = F.when(F.col("_clock") == kind, _part(F.col("_x"), p, 1) * 3600 + _part(F.col("_x"), p, 2) * 60 + _part(F.col("_x"), p, 3)).otherwise(clock)
    x = x.withColumn("_number", F.when(F.col("_clock").isNull(), F.regexp_extract("_x", plain, 1))).withColumn("_word", F.when(F.col("_clock").isNull(), F.lower(F.regexp_extract("_x", plain, 2))))
    x = with_number(x, "_number", "value").withColumn("unit", F.when(F.col("_clock").isNotNull(), "clock").when(F.col("value").isNotNull(), unit_of(F.col("_word"))))
    return x.withColumn("seconds", F.when(F.col("_clock").isNotNull(), clock).otherwise(seconds_of(F.col("value"), F.col("unit")))).drop("_x", "_clock", "_number", "_word")


def stated_unit(note: Column) -> Column:
    """The unit that a note states for retention times, null where it states none.

    Amounts (``24 h wash``) state nothing, nor do notes about anything else.
    """
    low = F.lower(note)
    words = F.regexp_replace(low, rf"[0-9]+(?:[.,][0-9]+)?\s*(?:{_ANY_UNIT})\b", " ")
    words = F.regexp_replace(words, "'s\\b|\"", " ")
    word = F.regexp_extract(words, r"(?<![\p{L}])(" + "|".join(x for x in "|".join(SPELLINGS.values()).split("|") if x not in ('\\"', "''", "″", "'", "′", "ore", "ora", "m")) + r")(?![\p{L}])", 1)
    return F.when(low.rlike(_ABOUT), unit_of(F.nullif(word, F.lit(""))))

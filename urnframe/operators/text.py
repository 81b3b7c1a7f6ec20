"""Text columns: folding, intents, report lines and sentences."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed keyword groups, tried in this order; the first group with a match names the intent.
INTENTS = [
    ("summarize", ["experiment", "compar", "resum", "run ganador"]),
    (
        "explain",
        [
            "por que",
            "porque",
            "explica",
            "resultado",
            "frecuencia",
            "entrop",
            "gap",
            "media",
            "promedio",
        ],
    ),
    ("interpret", ["interpret", "grafic", "chart", "significa", "tendencia"]),
    ("report", ["report", "informe", "documento"]),
]

# Fixed section headings and the word for a missing value.
HEADINGS = {
    "frequency": "## Frecuencias",
    "gap": "## Huecos",
    "average": "## Promedios",
    "probability": "## Probabilidades",
}
MISSING = "sin datos"


def _accents() -> tuple[str, str]:
    """Accented letter → bare letter, then the combining marks, which have no counterpart."""
    source, target = [], []
    for code in (c for c in range(0xC0, 0x110000) if unicodedata.decomposition(chr(c))):
        letter = chr(code)
        parts = [c for c in unicodedata.normalize("NFD", letter) if not unicodedata.combining(c)]
        if len(parts) == 1 and parts[0] != letter:
            source.append(letter)
            target.append(parts[0])
    marks = [chr(c) for c in range(0x300, 0x110000) if unicodedata.combining(chr(c))]
    return "".join(source + marks), "".join(target)


ACCENTED, BARE = _accents()


def fold_text(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(text), ACCENTED, BARE)


def classify_intent(text: Column) -> Column:
    """First keyword group with a match, else ``unknown``."""
    folded = fold_text(text)
    out = F.lit("unknown")
    for intent, words in reversed(INTENTS):
        found = F.lit(False)
        for word in words:
            found = found | F.contains(folded, F.lit(word))
        out = F.when(found, F.lit(intent)).otherwise(out)
    return out


def plain_number(value: Column) -> Column:
    """Decimal text without trailing zeros."""
    return F.regexp_replace(value.cast("decimal(20,6)").cast("string"), r"\.?0+$", "")


def or_missing(value: Column) -> Column:
    return F.coalesce(plain_number(value), F.lit(MISSING))


def report_lines(
    counts: DataFrame,
    gaps: DataFrame,
    averages: DataFrame,
    probabilities: DataFrame,
    scope: str | None = None,
) -> DataFrame:
    """Report lines (lottery_id, section_no, section, sort_key, line); one section if asked."""

    def rows(df: DataFrame, section: str, key: Column, line: Column) -> DataFrame:
        return df.select(
            "lottery_id",
            F.lit(list(HEADINGS).index(section) + 1).alias("section_no"),
            F.lit(section).alias("section"),
            key.alias("sort_key"),
            line.alias("line"),
        )

    dash, number = F.lit("- "), F.col("number").cast("string")
    by_number = F.lpad(number, 10, "0")
    parts = {
        "frequency": rows(
            counts,
            "frequency",
            by_number,
            F.concat(dash, number, F.lit(": "), F.col("n").cast("string")),
        ),
        "gap": rows(
            gaps,
            "gap",
            by_number,
            F.concat(dash, number, F.lit(": promedio "), or_missing(F.col("gap_avg"))),
        ),
        "average": rows(
            averages,
            "average",
            F.col("series"),
            F.concat(dash, "series", F.lit(": "), or_missing(F.col("mean"))),
        ),
        "probability": rows(
            probabilities,
            "probability",
            F.concat_ws("|", "model_id", "subject"),
            F.concat(
                dash, "model_id", F.lit(" ("), "subject", F.lit("): "), plain_number(F.col("value"))
            ),
        ),
    }
    if scope is not None:
        return parts[scope]
    out = None
    for part in parts.values():
        out = part if out is None else out.unionByName(part)
    return out


def report_text(lines: DataFrame) -> DataFrame:
    """One text per lottery and section: heading, then its lines (at most a few per number)."""
    ordered = F.sort_array(F.collect_list(F.struct("sort_key", "line")))["line"]
    heading = F.lit(None).cast("string")
    for section, words in HEADINGS.items():
        heading = F.when(F.col("section") == section, F.lit(words)).otherwise(heading)
    grouped = lines.groupBy("lottery_id", "section_no", "section").agg(ordered.alias("_l"))
    return grouped.select(
        "lottery_id",
        "section_no",
        F.concat(heading, F.lit("\n"), F.array_join("_l", "\n")).alias("body"),
    )


def explain_sentence(
    lottery: DataFrame,
    extremes: DataFrame,
    gap_extremes: DataFrame,
    averages: DataFrame,
    entropy: DataFrame,
) -> DataFrame:
    """One sentence per lottery from its extremes, mean jackpot and entropy."""
    jackpot = averages.where(F.col("series") == "jackpot").select("lottery_id", "mean")
    joined = (
        lottery.select("lottery_id", "code")
        .join(extremes, "lottery_id")
        .join(gap_extremes, "lottery_id", "left")
        .join(jackpot, "lottery_id", "left")
        .join(entropy, "lottery_id", "left")
    )
    sentence = F.concat(
        F.format_string(
            "Lottery %s: drawn most %d (%d times), drawn least %d (%d times)",
            "code",
            "hottest",
            "max_count",
            "coldest",
            "min_count",
        ),
        F.coalesce(
            F.format_string(
                "; longest mean gap %d (%s), shortest %d (%s)",
                "widest",
                plain_number(F.col("widest_avg")),
                "tightest",
                plain_number(F.col("tightest_avg")),
            ),
            F.lit(""),
        ),
        F.lit("; mean jackpot "),
        or_missing(F.col("mean")),
        F.coalesce(F.concat(F.lit("; entropy "), plain_number(F.col("entropy")), F.lit(" bits")), F.lit("")),
        F.lit("."),
    )
    return joined.select("lottery_id", sentence.alias("sentence"))

"""Language-column test and script-based language naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runassay import schema as S
from runassay.functions.similarity import nearest
from runassay.functions.text import cell, let

SIMPLIFIED = "简体中文"
TRADITIONAL = "繁体中文"
ENGLISH = "English"

# Frequent characters that exist in one of the two Chinese scripts only.
SIMPLIFIED_ONLY = "们这来国时说对会过还为个学与发经后样现从点问让应关没种结话义总传"
TRADITIONAL_ONLY = "們這來國時說對會過還為個學與發經後樣現從點問讓應關沒種結話義總傳"

HAN = "[一-鿿]"
LATIN = "[A-Za-zÀ-ɏ]"
MIX_SHARE = 0.2


def _count(text: Column, pattern: str) -> Column:
    """Characters in runs of ``pattern``: what removing the runs takes away."""
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))).cast(
        "double"
    )


def named_language(column: str | Column) -> Column:
    """Language by script; scripts holding over a fifth of the letters join with ``+``."""
    text = F.col(column) if isinstance(column, str) else column
    text = F.coalesce(text, F.lit(""))
    counts = F.struct(
        _count(text, f"{HAN}+").alias("han"),
        _count(text, f"{LATIN}+").alias("latin"),
        _count(text, f"[{SIMPLIFIED_ONLY}]+").alias("simplified"),
        _count(text, f"[{TRADITIONAL_ONLY}]+").alias("traditional"),
    )

    def name(n: Column) -> Column:
        least = (n.han + n.latin) * MIX_SHARE
        marked = n.simplified + n.traditional
        return F.concat_ws(
            "+",
            F.when((n.han > least) & (n.traditional > marked * MIX_SHARE), TRADITIONAL),
            F.when(
                (n.han > least) & ((n.simplified > marked * MIX_SHARE) | (marked == 0)),
                SIMPLIFIED,
            ),
            F.when(n.latin > least, ENGLISH),
        )

    # Most texts hold no Han at all: one look decides them, nothing is counted.
    mixed = let(let(counts, name), lambda v: F.when(v == "", "N/A").otherwise(v))
    return F.when(text.rlike(HAN), mixed).when(text.rlike(LATIN), ENGLISH).otherwise("N/A")


def language_headings(cells: DataFrame, value: str = "value") -> DataFrame:
    """Distinct normalised cells with ``is_language``; plain text tests come first.

    Only what neither equals nor contains a language word is compared with the headings,
    each distinct text once.
    """
    words = cells.select(cell(value).alias("word")).where(F.col("word") != "").distinct()
    plain = F.col("word").isin(S.LANGUAGE_HEADINGS)
    for part in S.LANGUAGE_HEADING_PARTS:
        plain = plain | F.col("word").contains(part)
    names = cells.sparkSession.createDataFrame([(h,) for h in S.LANGUAGE_HEADINGS], "name string")
    near = nearest(words.where(~plain), names, S.FUZZY_CUTOFF).select("word", F.lit(True).alias("_near"))
    return words.join(near, "word", "left").select(
        "word", (plain | F.coalesce("_near", F.lit(False))).alias("is_language")
    )

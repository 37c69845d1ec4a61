"""Scalar text functions, all native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runassay import schema as S

# ---- fixed values: patterns that must match the existing texts ----
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
NUMBER_FLOW = r"""(?i)<number-flow[^>]*?(?:value|aria-valuenow)=["']?([0-9.]+)["']?"""
JSON_BODY = r"(?s)(\{.*\})"
CITATION = r"\[\d+\]"
ID_CELL = r'^[\d\s",]+$'
# ---- end of fixed values ----

WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
NUMBER = r"(?i)^\s*[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"
REFERENCE_WORDS = [
    "http://", "https://", "www.", "reference:", "references:", "source:", "sources:",
    "参考", "參考", "来源", "來源",
]
LEADING_DOTS_ONLY = r"^[.]+[^.]*$"


def _c(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def stripped(column: str | Column) -> Column:
    """Both ends without white space of any kind."""
    return F.trim(_c(column), F.lit(WHITE_SPACE))


def stripped_text(column: str | Column) -> Column:
    """:func:`stripped` of long texts: trimming, which reads a whole text, only where an end is white."""
    text, white = _c(column), F.lit(False)
    for char in WHITE_SPACE:
        white = white | text.startswith(char) | text.endswith(char)
    return F.when(white, stripped(text)).otherwise(text)


def cell(column: str | Column) -> Column:
    return F.lower(stripped(F.coalesce(_c(column), F.lit(""))))


def base_name(column: str | Column) -> Column:
    name = _c(column)
    return F.when(name.rlike(LEADING_DOTS_ONLY), name).otherwise(
        F.regexp_replace(name, r"[.][^.]*$", "")
    )


def extension(column: str | Column) -> Column:
    name = _c(column)
    return F.when(name.rlike(LEADING_DOTS_ONLY), F.lit("")).otherwise(
        F.lower(F.regexp_extract(name, r"([.][^.]*)$", 1))
    )


def excerpt(
    column: str | Column, one_line: bool = True, chars: int | None = S.EXCERPT_CHARS
) -> Column:
    """The first ``chars`` characters (None: all), on one line if so wished."""
    head = _c(column) if chars is None else F.substring(_c(column), 1, chars)
    return F.replace(head, F.lit("\n"), F.lit(" ")) if one_line else head


def judge_document(column: str | Column, chars: int | None = S.DOCUMENT_CHARS) -> Column:
    """The first ``chars`` characters of a document; None leaves it whole."""
    return _c(column) if chars is None else F.substring(_c(column), 1, chars)


def clean_text(column: str | Column) -> Column:
    return F.regexp_replace(_c(column), CONTROL_CHARS, "")


def csv_safe(column: str | Column) -> Column:
    return F.translate(_c(column), ",", ";")


def seconds(column: str | Column) -> Column:
    """``12.5s`` -> 12.5; anything that is not a number -> null."""
    bare = F.replace(_c(column), F.lit("s"), F.lit(""))
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _side_of_tie(value: Column, low: Column, twice: float) -> Column:
    """Sign of ``value * twice - (2 * low + 1)``, free of rounding.

    The rounding error of the product is recovered by splitting ``value`` into
    two halves of 26 bits, whose products are exact.
    """
    product = value * twice
    high = value * 134217729.0 - (value * 134217729.0 - value)
    error = (high * twice - product) + (value - high) * twice
    return (product - (low * 2 + 1)) + error


def fixed_point(value: Column, digits: int) -> Column:
    """Text with ``digits`` decimals, rounded on the exact binary value, ties to even."""
    scale = 10**digits

    def rounded(v: Column) -> Column:
        low = F.floor(v * float(scale))
        return let(
            _side_of_tie(v, low, 2.0 * scale),
            lambda side: F.when(side < 0, low)
            .when(side > 0, low + 1)
            .otherwise(low + F.pmod(low, F.lit(2))),
        )

    def text(scaled: Column) -> Column:
        whole = F.floor(scaled / F.lit(scale)).cast("bigint").cast("string")
        part = F.pmod(scaled, F.lit(scale)).cast("string")
        return F.concat(whole, F.lit("."), F.lpad(part, digits, "0"))

    sign = F.when(value < 0, "-").otherwise("")
    return F.concat(sign, let(let(F.abs(value), rounded), text))


def share(count: str | Column, total: str | Column) -> Column:
    count, total = _c(count).cast("double"), _c(total).cast("double")
    return F.when(total > 0, count / total * 100.0).otherwise(F.lit(0.0))


def percent(count: str | Column, total: str | Column) -> Column:
    return F.concat(fixed_point(share(count, total), 2), F.lit("%"))


def json_body(column: str | Column) -> Column:
    """First ``{`` to last ``}``, or null where that is not one JSON object."""

    def if_one(body: Column) -> Column:
        listed = F.json_array_length(F.concat(F.lit("["), body, F.lit("]")))
        return F.when((body != "") & (listed == 1), body)

    return let(F.regexp_extract(_c(column), JSON_BODY, 1), if_one)


def block(column: str | Column, number: int) -> Column:
    """Text between the markers of one block; null where the block is missing."""
    text = _c(column)
    pattern = rf"(?s)---BLOCK{number}_START---\s*(.*?)\s*---BLOCK{number}_END---"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def numbers(column: str | Column) -> Column:
    """Numbers in a text; digit runs too long for a label are none."""
    found = F.regexp_extract_all(_c(column), F.lit(r"(\d+)"), 1)
    return F.array_compact(F.transform(found, lambda x: x.try_cast("bigint")))


def is_id_cell(column: str | Column) -> Column:
    return F.coalesce(stripped(column).rlike(ID_CELL), F.lit(False))


def page_times(column: str | Column) -> tuple[Column, Column]:
    """Preparation and completion time from the markup of a page."""
    found = F.regexp_extract_all(_c(column), F.lit(NUMBER_FLOW), 1)

    def nth(i: int) -> Column:
        return F.coalesce(
            F.concat(F.try_element_at(found, F.lit(i)), F.lit("s")), F.lit("N/A")
        )

    return nth(1), nth(2)


def has_citation(column: str | Column) -> Column:
    return F.coalesce(_c(column).rlike(CITATION), F.lit(False))


def has_reference(column: str | Column) -> Column:
    def any_of(text: Column) -> Column:
        hit = F.lit(False)
        for word in REFERENCE_WORDS:
            hit = hit | text.contains(word)
        return hit

    return F.coalesce(let(F.lower(_c(column)), any_of), F.lit(False))


def text_length(column: str | Column) -> Column:
    return F.char_length(stripped(column)).cast("bigint")


def evaluation_line(label: str = "label", chars: int | None = S.EXCERPT_CHARS) -> Column:
    return F.concat(
        F.lit("[Test ID: "), F.col(label).cast("string"), F.lit("] Eval: "),
        stripped("evaluation"), F.lit(" | Ans: "),
        excerpt(stripped_text(F.coalesce(F.col("answer"), F.lit("nan"))), chars=chars),
    )


def language_line(label: str = "label", chars: int | None = S.EXCERPT_CHARS) -> Column:
    return F.concat(
        F.lit("[Test ID: "), F.col(label).cast("string"), F.lit("] Input: "),
        F.col("input_language"), F.lit(", Output: "), F.col("output_language"),
        F.lit(" | Answer: "), excerpt("answer", one_line=False, chars=chars),
    )


def language_mix(column: str | Column) -> Column:
    return F.array_distinct(F.split(_c(column), r"\+"))

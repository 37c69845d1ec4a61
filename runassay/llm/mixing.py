"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runassay.llm.common import pin

DIMENSIONS = ("source", "lang", "topic")
#: A margin's target is its share of all tokens to this power, normalised.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}
SWEEPS = 6
#: Expected tokens of the mixture, as a share of all tokens.
BUDGET = 1.0
#: A sample takes no document twice: sweeps, largest relative gap of a margin, and within which
#: bounds and how often the budget is lowered until the gap is met.
SAMPLE_SWEEPS, MOST_GAP, LOWERED, LOWERINGS = 8, 0.03, (0.5, 0.95), 8
WORD_RE = r"[^\x20\x09-\x0D]+"
SYMBOL_RE = r"[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A text's topic by its form: marked up, with contacts, or prose by length."""
    n = words_of(text)
    return (
        F.when(2 * F.regexp_count(text, F.lit(SYMBOL_RE)) > n, "markup")
        .when(F.contains(text, F.lit("@")), "contact")
        .when(n < 150, "brief")
        .when(n < 1000, "article")
        .otherwise("longform")
    )


def with_margins(documents: DataFrame) -> list[Column]:
    """Columns ``source``, ``lang``, ``topic`` (null: empty text) and ``n_tokens``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in DIMENSIONS[:2]],
        topic_of(text).alias("topic"),
        words_of(text).alias("n_tokens"),
    ]


def tempered_targets(cells: DataFrame, powers: Mapping[str, float]) -> dict[str, DataFrame]:
    """Target share of each value of each dimension: its token share to a power."""
    out = {}
    for c, power in powers.items():
        sums = cells.groupBy(c).agg(F.pow(F.sum("n_tokens").cast("double"), F.lit(power)).alias("goal"))
        total = sums.agg(F.sum("goal")).first()[0] or 1.0
        out[c] = pin(sums.select(c, (F.col("goal") / total).alias("goal")), "targets")
    return out


def rake(
    cells: DataFrame,
    targets: Mapping[str, DataFrame],
    sweeps: int = SWEEPS,
    budget: float = 1.0,
    most: float | None = None,
) -> DataFrame:
    """``weight`` of each cell: tokens scaled so that every margin meets its target shares.

    Each step multiplies the weights of a value by target over present sum, and holds a cell
    to ``most`` times its tokens, if that is given. The weights add up to ``budget`` times all
    tokens. A value without a target gets none. The targets are joined once and a step sums the
    cells of a value in a window, so that plans stay short (a join a step made the plan of a
    sweep double with each step). Each sweep is written, so that a lost executor repeats one
    sweep at most.
    """
    total = budget * float(cells.agg(F.sum("n_tokens")).first()[0] or 0)
    out = cells.withColumn("weight", F.col("n_tokens").cast("double"))
    goals = {c: f"_goal_of_{c}" for c in targets}
    for c, target in targets.items():
        out = out.join(target.select(c, F.col("goal").alias(goals[c])), c, "left")
    for _ in range(sweeps):
        for c, goal in goals.items():
            rows = out.where(F.col(c).isNotNull()).withColumn("_now", F.sum("weight").over(Window.partitionBy(c)))
            factor = F.when(F.col("_now") > 0, F.coalesce(goal, F.lit(0.0)) * total / F.col("_now")).otherwise(0.0)
            weight = F.col("weight") * factor
            if most is not None:
                weight = F.least(weight, F.col("n_tokens") * F.lit(float(most)))
            out = rows.withColumn("weight", weight).drop("_now")
        out = pin(out, "raked")
    return out.drop(*goals.values())


def margin_shares(cells: DataFrame, targets: Mapping[str, DataFrame], column: str, whole: float) -> DataFrame:
    """``dimension, value, share, goal``: each value's ``column`` in parts of ``whole`` beside its target."""
    out = None
    for c, target in targets.items():
        sums = cells.groupBy(c).agg((F.sum(column) / F.lit(whole or 1.0)).alias("share")).join(target, c)
        rows = sums.select(F.lit(c).alias("dimension"), F.col(c).alias("value"), "share", "goal")
        out = rows if out is None else out.unionByName(rows)
    return out.where("goal > 0")


def calibrated(cells: DataFrame, targets: Mapping[str, DataFrame]) -> tuple[DataFrame, float]:
    """Weights of which none exceeds its cell's tokens, and the largest gap to a target share.

    The budget is the largest with which each value alone can meet its target. If the values
    together cannot, to within ``MOST_GAP`` of a target, it is lowered to what the scarcest
    value got, until they can.
    """
    total = float(cells.agg(F.sum("n_tokens")).first()[0] or 0)
    ratio = F.col("share") / F.col("goal")
    budget = min(1.0, margin_shares(cells, targets, "n_tokens", total).agg(F.min(ratio)).first()[0] or 1.0)
    for _ in range(LOWERINGS):
        raked = rake(cells, targets, SAMPLE_SWEEPS, budget, most=1.0)
        least, most = margin_shares(raked, targets, "weight", budget * total).agg(F.min(ratio), F.max(ratio)).first()
        gap = max(1 - (least or 1.0), (most or 1.0) - 1)
        if gap <= MOST_GAP:
            break
        budget *= min(max(least, LOWERED[0]), LOWERED[1])
    return raked, gap


def probabilities(
    documents: DataFrame,
    targets: Mapping[str, DataFrame] | None = None,
    sweeps: int = SWEEPS,
    budget: float = BUDGET,
) -> DataFrame:
    """Sampling rate of each (source, lang, topic) cell: budget times weight over tokens.

    Cells without tokens have rate ``budget``. A rate above 1 asks for several copies.
    """
    cells = pin(
        documents.select(*with_margins(documents))
        .groupBy(*DIMENSIONS)
        .agg(F.sum("n_tokens").alias("n_tokens")),
        "cells",
    )
    raked = rake(cells, targets or tempered_targets(cells, TEMPER), sweeps)
    rate = F.when(F.col("n_tokens") > 0, budget * F.col("weight") / F.col("n_tokens")).otherwise(F.lit(budget))
    return pin(raked.select(*DIMENSIONS, rate.alias("rate")), "rates")


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    head = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8)
    return F.conv(head, 16, 10).cast("long") / F.lit(4294967296.0)


def mix(documents: DataFrame, **options) -> DataFrame:
    """``copies`` of each document in the mixture, with its cell, tokens and ``rate``.

    ``copies`` is the whole part of the rate, and one more if the id's draw is below the
    rest. Null and empty texts have no tokens and are ``brief``; a null source or language
    is a value of its own (empty); repeated rows draw alike; null ids share a draw; other
    columns are ignored; an empty table gives no rows.
    """
    rates = probabilities(documents, **options)
    rows = documents.select("doc_id", *with_margins(documents))
    rest = F.col("rate") - F.floor("rate")
    return rows.join(rates, list(DIMENSIONS)).select(
        "doc_id",
        *DIMENSIONS,
        "n_tokens",
        F.round("rate", 6).alias("rate"),
        (F.floor("rate") + F.when(draw(F.col("doc_id")) < rest, 1).otherwise(0)).cast("int").alias("copies"),
    )


def sampled(documents: DataFrame, targets: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The documents that are drawn, each once at most, so that the margins meet their targets.

    No rate exceeds 1, so what is kept has the target shares, as far as draws allow; its size
    follows from the value that is scarcest against its target. Documents without tokens are
    kept. A null source or language is a value of its own; repeated rows are drawn alike; null
    ids share a draw; all columns are kept, whatever their names; an empty table stays empty.
    """
    margins = with_margins(documents)
    cells = pin(documents.select(*margins).groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("n_tokens")), "cells")
    raked, _ = calibrated(cells, targets or tempered_targets(cells, TEMPER))
    rate = F.when(F.col("n_tokens") > 0, F.col("weight") / F.col("n_tokens")).otherwise(F.lit(1.0))
    rates = pin(raked.select(*DIMENSIONS, rate.alias("rate")), "rates")
    rows = documents.select(F.struct("*").alias("row"), draw(F.col("doc_id")).alias("draw"), *margins[:3])
    return rows.join(rates, list(DIMENSIONS)).where("draw < rate").select("row.*")


def mix_sql(sweeps: int = SWEEPS, budget: float = BUDGET, powers: Mapping[str, float] = TEMPER) -> str:
    """DuckDB SQL for :func:`mix`, the sweeps written out one after another."""
    keys = ", ".join(DIMENSIONS)
    ctes = [
        f"""rows_ AS MATERIALIZED (
  SELECT doc_id, source, lang, CASE WHEN 2 * n_symbols > n_tokens THEN 'markup' WHEN contains(text, '@') THEN 'contact'
    WHEN n_tokens < 150 THEN 'brief' WHEN n_tokens < 1000 THEN 'article' ELSE 'longform' END AS topic, n_tokens
  FROM (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text,
    len(regexp_extract_all(coalesce(text, ''), '{WORD_RE}')) AS n_tokens,
    len(regexp_extract_all(coalesce(text, ''), '{SYMBOL_RE}')) AS n_symbols FROM documents))""",
        f"cells AS MATERIALIZED (SELECT {keys}, CAST(sum(n_tokens) AS DOUBLE) AS n_tokens FROM rows_ GROUP BY {keys})",
        "w0 AS (SELECT *, n_tokens AS weight FROM cells)",
    ]
    for c, power in powers.items():
        ctes.append(
            f"goal_{c} AS MATERIALIZED (SELECT {c}, pow(n, {power}) / sum(pow(n, {power})) OVER () AS goal "
            f"FROM (SELECT {c}, sum(n_tokens) AS n FROM cells GROUP BY {c}))"
        )
    step = 0
    for _ in range(sweeps):
        for c in powers:
            ctes.append(
                f"w{step + 1} AS MATERIALIZED (SELECT w.* REPLACE (w.weight * CASE WHEN s.now > 0 THEN g.goal * "
                f"(SELECT sum(n_tokens) FROM cells) / s.now ELSE 0 END AS weight) FROM w{step} w "
                f"JOIN (SELECT {c}, sum(weight) AS now FROM w{step} GROUP BY {c}) s ON s.{c} = w.{c} "
                f"JOIN goal_{c} g ON g.{c} = w.{c})"
            )
            step += 1
    ctes.append(
        f"rates AS (SELECT {keys}, CASE WHEN n_tokens > 0 THEN {budget} * weight / n_tokens ELSE {budget} END AS rate FROM w{step})"
    )
    draw_sql = "CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0"
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, {keys}, CAST(n_tokens AS BIGINT) AS n_tokens, round(rate, 6) AS rate, "
        f"CAST(floor(rate) + CASE WHEN {draw_sql} < rate - floor(rate) THEN 1 ELSE 0 END AS INTEGER) AS copies\n"
        f"FROM rows_ JOIN rates USING ({keys})"
    )

"""Bilingual agent catalog and resolution of agent names against it.

The catalog is a table ``catalog(en STRING, tc ARRAY<STRING>, pos BIGINT)``,
one row per written entry; ``pos`` is the writing order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runassay import schema as S
from runassay.functions.flags import is_traditional_route, resolution_state
from runassay.functions.similarity import nearest
from runassay.functions.text import stripped
from runassay.scale import null_safe_key


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("en string, tc array<string>, pos bigint").json(path)


def effective_catalog(catalog: DataFrame) -> DataFrame:
    """One entry per English name: the place of its first writing, the list of its last."""
    return catalog.groupBy("en").agg(
        F.max_by("tc", "pos").alias("tc"), F.min("pos").alias("pos")
    )


def duplicate_entries(catalog: DataFrame) -> DataFrame:
    """English names written more than once, and how many names that loses."""
    names = catalog.groupBy("en").agg(F.count(F.lit(1)).alias("entries")).where("entries > 1")
    written = catalog.select("en", F.explode("tc").alias("name")).distinct()
    kept = effective_catalog(catalog).select("en", F.explode("tc").alias("name"))
    lost = written.join(kept, ["en", "name"], "left_anti")
    return names.join(
        lost.groupBy("en").agg(F.count(F.lit(1)).alias("lost_names")), "en", "left"
    ).withColumn("lost_names", F.coalesce("lost_names", F.lit(0).cast("bigint")))


def valid_names(catalog: DataFrame) -> DataFrame:
    """English names and every listed name of the effective catalog, once each."""
    entries = effective_catalog(catalog)
    return (
        entries.select(F.explode(F.array_append("tc", F.col("en"))).alias("name"))
        .distinct()
    )


def folded_names(catalog: DataFrame) -> DataFrame:
    """Lower-case name -> least name that folds to it."""
    return valid_names(catalog).groupBy(F.lower("name").alias("folded")).agg(
        F.min("name").alias("name")
    )


def english_names(catalog: DataFrame) -> DataFrame:
    """Listed name -> English name; the later entry wins."""
    return (
        effective_catalog(catalog)
        .select(F.explode("tc").alias("name"), "en", "pos")
        .groupBy("name")
        .agg(F.max_by("en", F.struct("pos", "en")).alias("en"))
    )


def fuzzy_names(words: DataFrame, folded: DataFrame, cutoff: float = S.FUZZY_CUTOFF) -> DataFrame:
    """Best catalog name per distinct ``word`` by matching-block ratio, ties to the greatest."""
    asked = words.select("word").where(F.col("word").isNotNull()).distinct()
    names = folded.select(F.col("folded").alias("name")).distinct()
    return nearest(asked, names, cutoff).withColumnRenamed("name", "folded")


def resolve_names(
    names: DataFrame,
    catalog: DataFrame,
    cutoff: float = S.FUZZY_CUTOFF,
    fuzzy: bool = True,
) -> DataFrame:
    """Distinct stripped names -> (agent, how, ratio): exact, then case-folded, then fuzzy.

    ``agent`` is '' and ``how`` 'none' where nothing is near enough.
    """
    wanted = (
        names.select(stripped("agent").alias("raw")).where(F.col("raw") != "").distinct()
    )
    valid = valid_names(catalog).select("name", F.lit(True).alias("_exact"))
    folded = folded_names(catalog)
    known = (
        wanted.join(valid, F.col("raw") == F.col("name"), "left")
        .drop("name")
        .join(folded.withColumnRenamed("name", "_cased"),
              F.lower("raw") == F.col("folded"), "left")
        .drop("folded")
    )
    missing = known.where(F.col("_exact").isNull() & F.col("_cased").isNull())
    if not fuzzy:
        how = (
            F.when(F.col("_exact"), "exact")
            .when(F.col("_cased").isNotNull(), "case")
            .otherwise("none")
        )
        agent = F.when(F.col("_exact"), F.col("raw")).otherwise(F.coalesce("_cased", F.lit("")))
        none = F.lit(None).cast("double")
        return known.select("raw", agent.alias("agent"), how.alias("how"), none.alias("ratio"))
    near = (
        fuzzy_names(missing.select(F.lower("raw").alias("word")), folded, cutoff)
        .join(folded, "folded")
        .select("word", "ratio", F.col("name").alias("_near"))
    )
    how = (
        F.when(F.col("_exact"), "exact")
        .when(F.col("_cased").isNotNull(), "case")
        .when(F.col("_near").isNotNull(), "fuzzy")
        .otherwise("none")
    )
    agent = F.when(F.col("_exact"), F.col("raw")).otherwise(
        F.coalesce("_cased", "_near", F.lit(""))
    )
    return known.join(near, F.lower("raw") == F.col("word"), "left").select(
        "raw", agent.alias("agent"), how.alias("how"), "ratio"
    )


def with_candidates(resolved: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds the search candidates for both routes: ``tc_candidates``, ``en_candidates``."""
    entries = effective_catalog(catalog).select(F.col("en").alias("_en"), F.col("tc").alias("_tc"))
    english = english_names(catalog).select(
        F.col("name").alias("_name"), F.col("en").alias("_to_en")
    )
    none = F.array().cast("array<string>")
    some = F.col("agent") != ""
    return (
        resolved.join(entries, F.col("agent") == F.col("_en"), "left")
        .join(english, F.col("agent") == F.col("_name"), "left")
        .withColumns(
            {
                "tc_candidates": F.when(
                    some, F.coalesce("_tc", F.array("agent"))
                ).otherwise(none),
                "en_candidates": F.when(
                    some, F.array(F.coalesce("_to_en", "agent"))
                ).otherwise(none),
            }
        )
        .drop("_en", "_tc", "_name", "_to_en")
    )


def resolve_agents(
    tasks: DataFrame, catalog: DataFrame, task_keys: list[str], fuzzy: bool = True
) -> DataFrame:
    """Tasks with agent, state, language route and candidates.

    In: agent, language. Each distinct name is resolved once. Tasks without a
    name carry a salt, so they do not meet in one join task.
    """
    table = with_candidates(resolve_names(tasks, catalog, fuzzy=fuzzy), catalog).select(
        "raw", F.col("agent").alias("final_agent"), "how", "tc_candidates", "en_candidates"
    )
    table = table.withColumn("_salt_r", F.char_length("raw").cast("bigint") * 0)
    name = stripped(F.coalesce(F.col("agent"), F.lit("")))
    key, salt = null_safe_key(F.when(name != "", name), *task_keys)
    joined = tasks.withColumns({"_key": key, "_salt": salt}).join(
        table, (F.col("_key") == F.col("raw")) & (F.col("_salt") == F.col("_salt_r")), "left"
    )
    final = F.coalesce("final_agent", F.lit(""))
    candidates = F.coalesce(
        F.when(F.col("is_tc"), F.col("tc_candidates")).otherwise(F.col("en_candidates")),
        F.array().cast("array<string>"),
    )
    return joined.withColumn("is_tc", is_traditional_route("language")).select(
        *tasks.columns,
        "is_tc",
        final.alias("final_agent"),
        F.coalesce("how", F.lit("blank")).alias("how"),
        resolution_state(final).alias("state"),
        candidates.alias("candidates"),
    )


def first_offered(tasks: DataFrame, offered: DataFrame, keys: list[str]) -> DataFrame:
    """First candidate contained in a title the environment offers.

    In: tasks(keys, env, final_agent, candidates), offered(env, title). Rather
    than test every candidate against every title, titles are cut into their
    substrings of the lengths that candidates have, and candidates meet them by
    an equi-join: a title's work is its length times the number of such lengths.
    """
    title = F.lower(stripped("title"))
    # Tasks share few (env, candidates) pairs: look each pair up once.
    asked = tasks.select("env", "candidates").distinct()
    tried = asked.select(
        "env", "candidates", F.posexplode("candidates").alias("pos", "candidate")
    ).withColumn("piece", F.lower(stripped("candidate")))
    sizes = tried.select("env", F.char_length("piece").alias("_n")).where("_n > 0").distinct()
    starts = F.sequence(F.lit(1), F.char_length("t") - F.col("_n") + 1)
    pieces = (
        offered.select("env", title.alias("t"))
        .distinct()
        .join(sizes, "env")
        .where(F.char_length("t") >= F.col("_n"))
        .select("env", F.explode(F.transform(starts, lambda i: F.substring(F.col("t"), i, F.col("_n")))).alias("piece"))
        .distinct()
    )
    hits = (
        tried.join(pieces, ["env", "piece"], "left_semi")
        .groupBy("env", "candidates")
        .agg(F.min_by("candidate", "pos").alias("picked"))
    )
    has = F.size("candidates") > 0
    found = F.col("picked").isNotNull()
    return tasks.join(hits, ["env", "candidates"], "left").select(
        *keys, "env", "final_agent", "picked",
        F.when(~has | found, F.col("final_agent"))
        .otherwise(F.concat(F.col("final_agent"), F.lit(S.AGENT_NOT_OFFERED)))
        .alias("agent_used"),
        F.when(has & found, "4").otherwise("2").alias("state"),
    )

"""Routing columns: exam of a dataset id, backend of a model name, role tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markbook.plans.joins import join_small

# Ordered, case-insensitive markers of a dataset id.  The marker of
# the default exam is its publisher's id, which the caller gives.
EXAM_MARKERS = [("/cmmlu", "cmmlu"), ("/c-eval", "ceval")]

# Explicit series names and the backend of each.
SERIES = {
    "azure": "azure",
    "openai_chat": "chatgpt",
    "openai_complete": "oai_complete",
    "gemini": "gemini",
    "hf_chat": "hf_chat",
    "hf_base": "hf_base",
    "tgi": "tgi",
    "reka": "reka",
    "groq": "groq",
    "together": "together",
}


def exam_of(dataset: Column, default_marker: str | None = None, on_unknown: str = "error") -> Column:
    """Subject set of a dataset id; an unknown id fails, or is null by option."""
    low = F.lower(dataset)
    unknown = F.lit(None).cast("string")
    if on_unknown == "error":
        unknown = F.raise_error(F.concat(F.lit("dataset not supported: "), dataset)).cast("string")
    markers = ([(default_marker.lower(), "traditional")] if default_marker else []) + EXAM_MARKERS
    return F.coalesce(*[F.when(low.contains(marker), exam) for marker, exam in markers], unknown)


def backend_of(model: Column, series: Column | None = None) -> Column:
    """Backend of a model: its series if that is known, else by name in this order."""
    by_name = (
        F.when(model.contains("gemini"), "gemini")
        .when(model.contains("gpt-"), "chatgpt")
        .when(model.contains("claude"), "claude")
        .when(model.contains("Qwen"), F.when(F.lower(model).contains("chat"), "hf_chat").otherwise("hf_base"))
        .when(model.contains("qwen"), "dashscope")
        .when(model.contains("mixtral"), "mixtral")
        .when(model.contains("reka-"), "reka")
        .otherwise("tgi")
    )
    if series is None:
        return by_name
    explicit = F.coalesce(*[F.when(series == name, F.lit(backend)) for name, backend in SERIES.items()])
    return F.coalesce(explicit, by_name)


TOKENS = ("system_token", "end_token", "assistant_token", "user_token")


def first_templates(templates: DataFrame) -> DataFrame:
    """One row per model name: the first in file order, tokens as one struct.

    ``min_by`` is combined map-side, so a name repeated any number of times costs
    one row per task.
    """
    return templates.groupBy("model_name").agg(
        F.min_by(F.struct(*TOKENS), F.col("file_order")).alias("tokens")
    )


def supported_models(templates: DataFrame) -> DataFrame:
    """Names of all template rows, repeats included."""
    return templates.select("model_name")


def with_tokens(
    models: DataFrame, templates: DataFrame, model: str = "model_name", given: str | None = None, on_missing: str = "error"
) -> DataFrame:
    """Role tokens per model as the struct column ``tokens``.

    ``given`` names a struct of explicit tokens: if its user token is not empty the
    whole set replaces the looked-up one.  A model with neither fails the job, or
    gets null tokens with ``on_missing="null"``.
    """
    found = first_templates(templates).withColumnRenamed("model_name", model)
    rows = join_small(models, found, [model], "left")
    tokens = F.col("tokens")
    if given:
        tokens = F.when(F.length(F.col(given)["user_token"]) > 0, F.col(given)).otherwise(tokens)
    if on_missing == "error":
        missing = F.raise_error(F.concat(F.lit("no role tokens for model "), F.col(model)))
        fallback = F.struct(*[F.when(missing.cast("string").isNull(), "").alias(t) for t in TOKENS])
        tokens = F.when(tokens.isNull(), fallback).otherwise(tokens)
    return rows.withColumn("tokens", tokens)


def backend_params(backend: Column, cot: Column, model: Column | None = None) -> Column:
    """Generation parameters of a backend as struct<max_tokens, temperature>; null = unset."""
    # Fixed values: (tokens for worked answers, tokens otherwise, temperature).
    table: dict[str, Sequence] = {
        "tgi": (800, 200, 0.001),
        "groq": (800, 200, 0.0),
        "together": (800, 200, 0.0),
        "claude": (1200, 400, 0.1),
        "reka": (1000, 400, 0.0),
        "chatgpt": (800, 800, 0.0),
        "breeze": (800, 800, 0.0),
        "azure": (None, None, 0.0),
        "oai_complete": (None, None, 0.0),
        "dashscope": (None, None, None),
        "gemini": (None, None, None),
        "hf_chat": (None, None, None),
        "mixtral": (None, None, 0.2),
    }

    def pick(place: int, kind: str) -> Column:
        return F.coalesce(*[F.when(backend == name, F.lit(row[place]).cast(kind)) for name, row in table.items()])

    tokens = F.when(cot, pick(0, "int")).otherwise(pick(1, "int"))
    temperature = pick(2, "double")
    if model is not None:
        # The message endpoint of the newer model families takes no temperature.
        newer = model.contains("opus") | model.contains("sonnet") | model.contains("haiku")
        temperature = F.when((backend == "claude") & newer, F.lit(None)).otherwise(temperature)
    return F.struct(tokens.alias("max_tokens"), temperature.alias("temperature"))

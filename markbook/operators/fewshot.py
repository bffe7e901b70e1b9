"""Few-shot context per subject, and its join to the rows to be answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markbook.functions import blocks
from markbook.functions.extract import CHOICES
from markbook.operators.runs import with_names
from markbook.plans.joins import join_small
from markbook.plans.running import first_rows

def exemplar_rows(dev: DataFrame, k: int, policy: str = "all") -> DataFrame:
    """The first ``k`` rows per subject by ``row_idx`` with their place as ``rank``.

    ``k = -1`` takes all rows, whose context is then one cell as long as they are;
    ``policy="first_only"`` keeps the first one only, as
    some backends do whatever ``k`` says.
    """
    if policy == "first_only" and k != 0:
        k = 1
    if k == -1:
        return dev
    return first_rows(dev, ["subject"], "row_idx", max(k, 0)).drop("rank")


def _in_order(item: Column) -> Column:
    """The group's items as an array in ``row_idx`` order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("row_idx"), item.alias("item"))))
    return F.transform(ordered, lambda x: x["item"])


def _with_names(per_subject: DataFrame, names: DataFrame | None) -> DataFrame:
    """Display name per subject (the subject itself where the table has none)."""
    if names is None:
        return per_subject.withColumn("name", F.col("subject"))
    return with_names(per_subject, names)


def message_context(
    dev: DataFrame, k: int, names: DataFrame | None = None, choices=CHOICES, cot: bool = False, direct: bool = False, policy: str = "all"
) -> DataFrame:
    """(subject, context): system header, then user/assistant turns per example.

    The exam header opens the first example's user turn.
    """
    rows = exemplar_rows(dev, k, policy).select("subject", "row_idx", blocks.exemplar_messages(choices, cot).alias("turns"))
    per_subject = _with_names(rows.groupBy("subject").agg(F.flatten(_in_order(F.col("turns"))).alias("turns")), names)
    first = F.col("turns")[0]
    opened = blocks.message("user", F.concat(blocks.user_header(F.col("name"), direct), first["content"]))
    system = blocks.message("system", blocks.system_header(F.col("name"), direct))
    context = F.concat(F.array(system, opened), F.slice(F.col("turns"), F.lit(2), F.size("turns") - 1))
    return per_subject.select("subject", context.alias("context"))


def pair_context(dev: DataFrame, k: int, names: DataFrame | None = None, choices=CHOICES, cot: bool = False) -> DataFrame:
    """(subject, context): (query, answer) pairs, the header opening the first query."""
    rows = exemplar_rows(dev, k).select("subject", "row_idx", blocks.history_pair(choices, cot).alias("pair"))
    per_subject = _with_names(rows.groupBy("subject").agg(_in_order(F.col("pair")).alias("pairs")), names)
    header = blocks.user_header(F.col("name"))
    context = F.transform(
        "pairs",
        lambda p, i: F.struct(
            F.when(i == 0, F.concat(header, p["query"])).otherwise(p["query"]).alias("query"), p["answer"].alias("answer")
        ),
    )
    return per_subject.select("subject", context.alias("context"))


def text_context(dev: DataFrame, k: int, block: Column, names: DataFrame | None = None) -> DataFrame:
    """(subject, context): the exam header and the answered blocks as one text."""
    rows = exemplar_rows(dev, k).select("subject", "row_idx", block.alias("block"))
    per_subject = _with_names(rows.groupBy("subject").agg(F.array_join(_in_order(F.col("block")), "").alias("body")), names)
    return per_subject.select("subject", F.concat(blocks.user_header(F.col("name")), F.col("body")).alias("context"))


def transcript_context(dev: DataFrame, k: int, names: DataFrame | None = None, choices=CHOICES) -> DataFrame:
    """(subject, context): an instruction transcript with its opening exchange."""
    rows = exemplar_rows(dev, k).select("subject", "row_idx", blocks.instruct_exemplar(choices).alias("block"))
    per_subject = _with_names(rows.groupBy("subject").agg(F.array_join(_in_order(F.col("block")), "").alias("body")), names)
    return per_subject.select("subject", F.concat(blocks.instruct_opening(F.col("name")), F.col("body")).alias("context"))


def attach_context(rows: DataFrame, context: DataFrame) -> DataFrame:
    """Each row to be answered with its subject's context.

    The context table has one row per subject and is computed once; it is
    broadcast when its measured size allows, and joined on salted keys otherwise.
    """
    return join_small(rows, context, ["subject"], "left")


def zero_shot_messages(name: Column, choices=CHOICES, direct: bool = False) -> Column:
    """System header and the question with the exam header, without examples."""
    question = F.concat(blocks.user_header(name, direct), blocks.question_block(choices))
    return F.array(blocks.message("system", blocks.system_header(name, direct)), blocks.message("user", question))


def few_shot_messages(context: Column, choices=CHOICES) -> Column:
    """The subject's context followed by the row's own question."""
    return F.concat(context, blocks.question_messages(choices))

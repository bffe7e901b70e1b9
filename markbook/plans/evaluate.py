"""A whole evaluation as one Spark job per stage: prompts, replies, marks, ledger.

Replies are stored in waves of (model, subject) under a hash of what was asked, before they are
marked: a marking error or a lost run repeats at most the wave under way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook.functions import blocks, render, scores, scoring
from markbook.functions.extract import CHOICES
from markbook.functions.text import Script
from markbook.operators import fewshot, inference, report, routing, runs
from markbook.plans.backends import Backend
from markbook.plans.joins import join_small
from markbook.session import cut_lineage, written
from markbook.sources import commits, replies, results


PROMPT_BYTES = 256 * 1024 * 1024  # of prompts that one task builds, sorts and writes, about
WORDING = 512  # what the wording adds to a question or an example, about


def _with_context(rows: DataFrame, context: DataFrame | None) -> DataFrame:
    return fewshot.attach_context(rows, context) if context is not None else rows


def prompt_bytes(test: DataFrame, dev: DataFrame | None, tasks: DataFrame, k: int = 0) -> int:
    """About how large all prompts together are, from the texts that go into them; nothing is rendered."""
    text = lambda rows: F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))).cast("double"))
    sizes = test.groupBy("subject").agg(F.count("*").alias("_n"), text(test).alias("_own"))
    sizes = sizes.join(tasks.groupBy("subject").agg(F.count("*").alias("_models")), "subject")
    shot = F.lit(0.0)
    if k != 0 and dev is not None:
        size = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in dev.columns]))) + WORDING
        per_subject = dev.groupBy("subject").agg(F.sum(size.cast("double")).alias("_all"), F.max(size.cast("double")).alias("_most"))
        sizes = sizes.join(per_subject, "subject", "left")
        shot = F.coalesce(F.col("_all") if k < 0 else F.least("_all", F.col("_most") * k), F.lit(0.0))
    total = F.sum(F.col("_models") * (F.col("_own") + F.col("_n") * (shot + WORDING)))
    return int(sizes.agg(total.alias("bytes")).first()["bytes"] or 0)


def dealt_for_prompts(test: DataFrame, dev: DataFrame | None, tasks: DataFrame, k: int = 0) -> DataFrame:
    """``test`` dealt by a hash of the row, so that no task builds much more than PROMPT_BYTES of prompts.

    A question becomes one prompt per model and a folder's rows are sorted together where they are written: what a task
    holds is a matter of the prompts, not of the bank's files.  Moved before the join, rows are as small as they get.
    """
    parts = -(-prompt_bytes(test, dev, tasks, k) // PROMPT_BYTES)
    return test.repartition(parts, *[F.col(f"`{c}`") for c in test.columns]) if parts > 1 else test


def build_prompts(
    rows: DataFrame,
    dev: DataFrame | None,
    backend: Backend,
    k: int = 0,
    cot: bool = False,
    names: DataFrame | None = None,
    choices=CHOICES,
    tokens: Column | None = None,
    script: Script | None = None,
    with_prompt: bool = False,
) -> DataFrame:
    """``rows`` (bank columns and ``name``) plus the backend's ``prompt`` text.

    ``k = 0`` is zero-shot.  Message lists, segments and pairs become JSON text.
    """
    shots = k != 0 and dev is not None
    name = F.col("name")
    if backend.style == "messages":
        context = fewshot.message_context(dev, k, names, choices, cot, backend.direct, backend.few_shot) if shots else None
        rows = _with_context(rows, context)
        if shots:
            # A subject without worked examples is asked without them.
            empty = F.array(blocks.message("system", blocks.system_header(name, backend.direct)))
            messages = fewshot.few_shot_messages(F.coalesce(F.col("context"), empty), choices)
        else:
            messages = fewshot.zero_shot_messages(name, choices, backend.direct)
        rows = rows.withColumn("_messages", messages)
        messages = F.col("_messages")
        if backend.render == "chat":
            prompt = render.render_chat(messages, render.column_tokens(tokens) if tokens is not None else None)
        elif backend.render == "turns":
            prompt = render.render_turns(messages)
        else:
            if backend.render == "segments":
                # Converted as rendered: the cue in front of a question too.
                segments = render.render_segments(messages)
                prompt = F.to_json(script.texts(segments) if script else segments)
            else:
                messages = script.messages(messages) if script else messages
                prompt = render.render_lines(messages) if backend.render == "lines" else F.to_json(messages)
        if script and backend.render in ("chat", "turns"):
            prompt = script.column(prompt)
    elif backend.style == "pairs":
        rows = _with_context(rows, fewshot.pair_context(dev, k, names, choices, cot) if shots else None)
        history = F.col("context") if shots else F.array().cast("array<struct<query string, answer string>>")
        query = blocks.history_query(choices)
        if script:
            query = script.column(query)
            history = script.pairs(history)
        prompt = F.to_json(F.struct(history.alias("history"), query.alias("query")))
    else:
        if backend.style == "base":
            block, answered = blocks.base_block(choices, cot=cot), blocks.base_block(choices, answered=True, cot=cot)
        else:
            block = blocks.instruct_block(choices, cot=cot, with_prompt=with_prompt)
            block = blocks.instruct_wrap(block) if with_prompt else block
            answered = blocks.instruct_block(choices, answered=True, cot=cot)
        if shots and backend.style == "instruct" and with_prompt:
            rows = _with_context(rows, fewshot.transcript_context(dev, k, names, choices))
        elif shots:
            rows = _with_context(rows, fewshot.text_context(dev, k, answered, names))
        prompt = F.concat(F.coalesce(F.col("context"), F.lit("")), block) if shots else block
        prompt = script.column(prompt) if script else prompt
    return rows.withColumn("prompt", prompt).drop("_messages", "context")


def mark_replies(
    rows: DataFrame,
    backend: Backend,
    few_shot: bool,
    cot: bool,
    parsing: str = "string",
    script: Script | None = None,
    choices=CHOICES,
) -> DataFrame:
    """Replies to ``extracted`` and ``correctness`` under the backend's policy."""
    if backend.reads != "text":
        if backend.reads == "scores":
            letter = scores.argmax_choice(F.from_json("response", "array<double>"), choices)
        else:
            pair = F.from_json("response", "array<array<double>>")
            letter = scores.argmax_sum(F.get(pair, 0), F.get(pair, 1), choices, on_invalid="null")
        rows = rows.withColumn("extracted", letter)
        return rows.withColumn("correctness", scoring.as_mark(F.col("extracted") == F.col("answer"), F.col("answer")))
    if parsing == "llm" or backend.shot_rule == "judge":
        return scoring.marks(rows, "judge", judged="judged", choices=choices)
    policy = "cot" if cot else (backend.shot_rule if few_shot else "zero_shot")
    return scoring.marks(rows, policy, simplified=script is not None, choices=choices, script=script)


def settings_key(backend: str, k: int, cot: bool, simplified: bool, settings: tuple) -> str:
    """The name of a run in the ledger: readable, and told apart by everything that is set."""
    parts = [backend, f"top_{k}" if k else "", "cot" if cot else "", "zhs" if simplified else "", hashlib.sha256(repr(settings).encode()).hexdigest()[:12]]
    return "_".join(p for p in parts if p)


def evaluate(
    bank: DataFrame,
    tasks: DataFrame,
    backend: Backend,
    make: Callable,
    out: str,
    names: DataFrame | None = None,
    k: int = 0,
    cot: bool = False,
    parsing: str = "string",
    judge_make: Callable | None = None,
    templates: DataFrame | None = None,
    script: Script | None = None,
    choices=CHOICES,
    max_samples: int | None = None,
    resume_by=("model", "subject"),
    split: str = "test",
    concurrency: int | None = None,
    tokens: dict[str, str] | None = None,
    with_prompt: bool = False,
    blind: bool = False,
    wave: int = 64,
    **options,
) -> DataFrame:
    """Run all pending (model, subject) ``tasks`` and append their accuracies.

    Writes ``replies``, ``judged``, ``scored`` and ``ledger`` under ``out``, which must be a
    folder all executors share, and returns this run's accuracies with ``n_failed``, the rows
    that got no answer.  Those rows count neither as right nor as wrong, and their task stays
    out of the ledger: a later run asks only for what is missing.

    A task is finished if the ledger holds it for the same settings and the same prompts.  A changed
    question, example, template, name or parameter makes it pending again, and only the prompts that
    changed are sent: a reply belongs to the prompt that it answers, also across runs of other settings.
    With ``resume_by=["subject"]`` a subject that any model finished under these settings is left out.

    Tasks run in waves of about ``wave``; the replies of a wave are stored before the next one
    begins and before anything is marked.  ``concurrency`` is the number of tasks that call a
    model or the judge.  ``tokens`` (system, end, assistant, user) replaces the looked-up role
    tokens; ``blind`` marks without gold answers.
    """
    if parsing == "llm" and not backend.judge:
        raise ValueError(f"backend {backend.name} does not support judge marking")
    spark = bank.sparkSession
    key = ["model", "subject"]
    settings = (backend, k, cot, split, tuple(choices), with_prompt, tokens, parsing, blind, max_samples, script and (script.chars, script.phrases))
    run = settings_key(backend.name, k, cot, script is not None, settings)
    tasks = cut_lineage(tasks.select(*key).distinct())  # read many times below
    waves = max(1, min(replies.PLACES, -(-tasks.count() // wave)))

    test = bank.where(F.col("split") == split).drop("split", "explanation")
    if max_samples is not None:
        test = runs.cap_samples(test, max_samples)
    test = runs.with_names(test, names) if names is not None else test.withColumn("name", F.col("subject"))
    dev = bank.where(F.col("split") == "train")
    chat = backend.render == "chat" and (templates is not None or tokens is not None)
    role_tokens = F.col("tokens") if chat else None
    rows = runs.questions_per_model(dealt_for_prompts(test, dev, tasks, k), tasks)
    if chat and tokens is not None:
        rows = rows.withColumn("tokens", F.struct(*[F.lit(tokens[t.removesuffix("_token")]).alias(t) for t in routing.TOKENS]))
    elif chat:
        rows = routing.with_tokens(rows, templates, "model")
    prompts = build_prompts(rows, dev, backend, k, cot, names, choices, role_tokens, script, with_prompt)
    prompts = prompts.withColumn("params", routing.backend_params(F.lit(backend.name), F.lit(cot), F.col("model")))
    prompts = prompts.withColumn("key", replies.reply_key(F.col("prompt"), F.col("params"), F.col("model"), backend.name))
    end_token = role_tokens["end_token"] if chat else F.lit(None).cast("string")
    # Built once; a wave reads the folders of its places.
    prompts = prompts.withColumn("end_token", end_token).drop("tokens").withColumn("place", replies.task_place())
    prompts = written(prompts, "prompts", ["place"])

    contents = prompts.groupBy(*key).agg(F.concat_ws(":", F.count("*"), F.sum(F.xxhash64("key").cast("decimal(20,0)"))).alias("content"))
    contents = cut_lineage(contents)  # a row per task
    ledger = results.committed_ledger(spark, f"{out}/ledger", run)
    if tuple(resume_by) == ("model", "subject"):
        contents = contents.join(ledger.select(*key, "content"), [*key, "content"], "left_anti")
    else:
        contents = runs.pending_tasks(contents, ledger, resume_by)
    contents = cut_lineage(contents)
    pending = contents.select(*key)

    calls = {"concurrency": concurrency, **options}
    stored = (spark, f"{out}/replies", replies.STORED, "status")
    for number in range(0 if contents.isEmpty() else waves):
        low, high = (replies.PLACES * n // waves for n in (number, number + 1))
        wanted = join_small(prompts.where(F.col("place").between(low, high - 1)), pending, key, "left_semi")
        asked = replies.unanswered(wanted.select(*key, "key", "prompt", "params", "place"), replies.outcomes(*stored, low, high), "status")
        got = inference.batch_generate(asked, make, params=F.col("params"), fold_on_server_error=backend.resend_folded, **calls)
        commits.append(got.drop("prompt", "params"), f"{out}/replies", ["place"])

    wanted = join_small(prompts.drop("prompt", "params", "place"), pending, key, "left_semi")
    answered = wanted.join(replies.outcomes(*stored).drop(*key), "key", "left")
    failed = replies.failed("status")
    if chat:
        answered = inference.clean_response(answered, F.col("end_token"))
    else:
        answered = inference.clean_response(answered)
    if parsing == "llm" or backend.shot_rule == "judge":
        # The judge sees the response alone, so equal responses are judged once.
        answered = written(answered.withColumn("_reply", F.col("key")).withColumn("key", F.sha2("response", 256)), "answered")
        judged = (spark, f"{out}/judged", replies.JUDGED, "judge_status")
        asked = replies.unanswered(answered.where(~failed).select("key", "response"), replies.outcomes(*judged), "judge_status")
        labels = inference.judge(asked, judge_make, **calls).withColumn("place", replies.key_place())
        commits.append(labels.select("key", "judged", "judge_status", "place"), f"{out}/judged", ["place"])
        answered = join_small(answered, replies.outcomes(*judged), ["key"], "left").drop("key").withColumnRenamed("_reply", "key")
        failed = failed | replies.failed("judge_status")
    if blind:
        answered = scoring.blind(answered)
    marked = mark_replies(answered.drop("end_token"), backend, k != 0, cot, parsing, script, choices)
    marked = marked.withColumn("failed", failed).withColumn("correctness", F.when(~F.col("failed"), F.col("correctness"))).withColumn("run", F.lit(run))
    results.write_scored(marked, f"{out}/scored", by=("run", *key))

    scored = results.read_scored(spark, f"{out}/scored", marked.schema).where(F.col("run") == run)
    accuracy = report.accuracy_by_subject(join_small(scored, pending, key, "left_semi"), failed="failed")
    done = accuracy.where("n_failed = 0").join(contents, key).withColumn("run", F.lit(run))
    results.commit_ledger(done, f"{out}/ledger")
    return accuracy

"""Batch inference through a caller's function, with bounded retries.

``make()`` runs once per task and returns ``call(prompts, params) -> replies``: two lists
in, one list out that holds per prompt a text, None, or an exception object.  Only the
prompt and its parameters cross to Python; all other columns stay in the JVM.  Outcomes
are columns, so a failed row never fails the job; a fault of the function itself does.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markbook.functions import blocks, extract
from markbook.functions.text import cut_at_stop, fold_brackets, strip, text_or_empty
from markbook.schema import GENERATED

# Workers get these functions with the job, so they need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ALTERNATE_TEMPERATURE = 0.3


class ServerError(RuntimeError):
    """Raised by ``call`` when the server rejects a prompt as such."""

    server_error = True


# Faults of the caller's function, not of the model behind it: they end the job.
PROGRAM_ERRORS = (TypeError, NameError, AttributeError, ImportError, SyntaxError)
# Statuses of prompts that were never answered; they are asked again by a later run.
FAILED = ("error", "timeout", "server_error")


class _Prompt:
    """One prompt on its way: what is sent next, and how its last attempt ended."""

    def __init__(self, prompt: str, alternate: str | None, param: dict, attempts: int):
        self.prompt, self.alternate, self.param, self.left = prompt, alternate, param, attempts
        self.attempts, self.status, self.text, self.error = 0, "error", None, None
        self.rejected = False

    def take(self, outcome, warmer: float) -> None:
        """Count an attempt that ended with a text, with None or with an exception."""
        self.attempts, self.left = self.attempts + 1, self.left - 1
        if not isinstance(outcome, Exception):
            self.text = None if outcome is None else str(outcome)
            self.status, self.error, self.left = "empty" if outcome is None else "ok", None, 0
            return
        if isinstance(outcome, PROGRAM_ERRORS):
            raise outcome
        self.error = f"{type(outcome).__name__}: {outcome}"
        if getattr(outcome, "server_error", False):
            self.status = "server_error"
            if self.alternate is not None:
                # Resend once, folded and warmer; a second failure ends the row.
                self.prompt, self.alternate, self.rejected, self.left = self.alternate, None, True, 1
                self.param = {**self.param, "temperature": warmer}
        elif self.status != "server_error":
            late = isinstance(outcome, TimeoutError) or "timeout" in str(outcome)
            self.status = "timeout" if late else "error"


def _outcomes(call: Callable, prompts: list[_Prompt]) -> list:
    """What one call returns per prompt; an exception out of the call counts for all of them."""
    try:
        replies = list(call([p.prompt for p in prompts], [p.param for p in prompts]))
        if len(replies) != len(prompts):
            raise ValueError("one reply per prompt expected")
        return replies
    except Exception as exc:  # noqa: BLE001 - any client error becomes a status
        return [exc] * len(prompts)


def _answer_batch(call: Callable, prompts: list, alternates: list, params: list, limits: dict) -> pd.DataFrame:
    """A batch in one call, then further calls with only those prompts that failed.

    A call that fails as a whole may do so because of one prompt: its prompts go on one by one.
    """
    rows = [None if p is None else _Prompt(p, a, o, limits["max_attempts"]) for p, a, o in zip(prompts, alternates, params)]
    calls = [[r for r in rows if r is not None]]
    while calls := [c for c in calls if c]:
        again = []
        for group in calls:
            outcomes = _outcomes(call, group)
            for row, outcome in zip(group, outcomes):
                row.take(outcome, limits["alternate_temperature"])
            rest = [r for r in group if r.left > 0]
            whole = len(group) > 1 and all(o is outcomes[0] for o in outcomes) and isinstance(outcomes[0], Exception)
            again += [[r] for r in rest] if whole else [rest]
        calls = again
        if limits["backoff"] and any(not r.rejected for c in calls for r in c):
            time.sleep(limits["backoff"])
    out = [(None, "skipped", 0, None) if r is None else (r.text, r.status, r.attempts, r.error) for r in rows]
    return pd.DataFrame(out, columns=["response", "status", "attempts", "error"]).astype({"attempts": "int32"})


def _texts(values: pd.Series) -> list:
    return [None if pd.isna(v) else v for v in values]


def _params(frame: pd.DataFrame) -> list[dict]:
    return [{k: None if pd.isna(v) else v for k, v in row.items()} for row in frame.to_dict("records")]


def _generate_udf(make: Callable, batch: int, limits: dict):
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        call = make()
        for prompts, alternates, params in batches:
            asked, other, options = _texts(prompts), _texts(alternates), _params(params)
            parts = [
                _answer_batch(call, asked[i : i + batch], other[i : i + batch], options[i : i + batch], limits)
                for i in range(0, len(asked), batch)
            ]
            yield pd.concat(parts, ignore_index=True)

    # Never evaluated twice or moved by the optimizer: a call costs money and time.
    return F.pandas_udf(run, GENERATED).asNondeterministic()


def dealt_by_length(rows: DataFrame, prompt: Column, callers: int) -> DataFrame:
    """``rows`` in ``callers`` partitions whose prompts are about as long in total.

    Each partition sorts its rows, longest first, and deals them to and fro: the first round goes to the callers in order, the
    next one backwards.  What two callers get from a partition then differs by less than its longest prompt, however the
    lengths are spread.  One exchange, as for any dealing out; equal lengths are ordered by a hash of the row, so a
    task that is run again deals alike.
    """
    size, place = "_prompt_length_", "_caller_"
    sized = rows.withColumn(size, F.coalesce(F.length(prompt), F.lit(0)))
    ordered = sized.sortWithinPartitions(F.col(size).desc(), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
    numbered = ordered.withColumn(place, F.monotonically_increasing_id())
    # The number of the partition is above bit 33; it turns the callers, so that not all partitions begin with the same one.
    part, row = F.shiftright(place, 33), F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    turn = F.pmod(row, F.lit(callers))
    caller = F.when(F.pmod(F.floor(row / callers), F.lit(2)) == 0, turn).otherwise(callers - 1 - turn)
    turned = F.floor(part * 0.6180339887 * callers)  # steps by the golden ratio never bunch up
    caller = F.pmod(caller + turned, F.lit(callers)).cast("int")
    return numbered.withColumn(place, caller).repartitionById(callers, place).drop(size, place)


def batch_generate(
    rows: DataFrame,
    make: Callable[[], Callable],
    prompt: Column | str = "prompt",
    params: Column | None = None,
    fold_on_server_error: bool = False,
    batch: int = 64,
    max_attempts: int = 31,
    backoff: float = 5.0,
    concurrency: int | None = None,
) -> DataFrame:
    """``rows`` plus response, status, attempts and error.

    ``concurrency`` deals the rows to that many tasks right before the call, which bounds
    the calls in flight; prompts are dealt by length, so the tasks end at about the same time.  ``attempts`` counts every call that a prompt was in.  A null prompt is not sent.  With ``fold_on_server_error`` a rejected
    prompt is resent once with plain brackets at a higher temperature, within the
    same task, so the rest of the run is not repeated.
    """
    prompt = F.col(prompt) if isinstance(prompt, str) else prompt
    if params is None:
        params = F.struct(F.lit(None).cast("int").alias("max_tokens"), F.lit(None).cast("double").alias("temperature"))
    folded = fold_brackets(prompt) if fold_on_server_error else F.lit(None).cast("string")
    limits = {"max_attempts": max_attempts, "backoff": backoff, "alternate_temperature": ALTERNATE_TEMPERATURE}
    if concurrency:
        rows = dealt_by_length(rows, prompt, concurrency)
    generated = rows.withColumn("_out", _generate_udf(make, batch, limits)(prompt, folded, params))
    return generated.select(*rows.columns, "_out.*")


def clean_response(rows: DataFrame, stop: Column | None = None) -> DataFrame:
    """Missing replies as empty text, text after the stop token cut off."""
    text = text_or_empty(F.col("response"))
    return rows.withColumn("response", cut_at_stop(text, stop) if stop is not None else text)


def judge(
    rows: DataFrame,
    make: Callable[[], Callable],
    response: str = "response",
    unknown: bool = False,
    strip_reply: bool = True,
    **options,
) -> DataFrame:
    """``rows`` plus the judge's ``judged`` label and ``judge_status``.

    Empty responses are not sent; their label is empty.  ``rows`` should come from
    a written table, so that a judge failure does not repeat the generation.
    """
    text = strip(text_or_empty(F.col(response)))
    prompt = F.when(F.length(text) > 0, blocks.judge_prompt(text, unknown=unknown))
    aside = rows.select(F.struct(*rows.columns).alias("_row"), prompt.alias("_prompt"))
    asked = batch_generate(aside, make, "_prompt", **options)
    label = extract.judge_label(F.col("response")) if strip_reply else text_or_empty(F.col("response"))
    back = [F.col("_row")[c].alias(c) for c in rows.columns]
    return asked.select(*back, label.alias("judged"), F.col("status").alias("judge_status"))

"""Answer extraction: an ordered cascade of patterns over one response column.

A cascade is tried in priority order; the first pattern that matches anywhere
decides, and the answer is the last of its matches.  Everything is one Catalyst
expression per response: map-only, no shuffle and no Python worker.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from markbook import fixed_values as fixed
from markbook.functions.text import SPACE, Script, strip, text_or_empty

CHOICES = ("A", "B", "C", "D")
_WORD = r"[\p{L}\p{N}_]"


def jvm_pattern(pattern: str, choices: Sequence[str] = CHOICES) -> str:
    """One pattern in the JVM dialect, for the given answer letters.

    White space and word boundaries are spelled out because the JVM's default
    classes are narrower than Python's; ``(?d)`` leaves only the newline special.
    """
    letters = "[" + "".join(map(re.escape, choices)) + "]"
    pattern = pattern.replace("[A-D]", letters) if tuple(choices) != CHOICES else pattern
    pattern = pattern.replace(r"\s", SPACE)
    pattern = pattern.replace(r"\b(", f"(?<!{_WORD})(").replace(r")\b", f")(?!{_WORD})")
    return "(?d)" + pattern


def _literal_start(pattern: str) -> str:
    """The plain text every match of the pattern begins with (may be empty)."""
    if "|" in pattern:
        return ""
    plain = re.match(r"[^\\\[\](){}.*+?^$]*", pattern)[0]
    optional = pattern[len(plain) : len(plain) + 1] in ("?", "*", "{")
    return plain[:-1] if optional else plain


def _quoted(plain: str) -> str:
    return "'" + plain.replace("'", "\\'") + "'"


def _raw(pattern: str) -> str:
    """The pattern as a raw SQL literal."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _attempt(pattern: str, choices: Sequence[str], every: bool) -> str:
    """One guarded attempt as SQL over ``t``; a plain-text test runs before the regex."""
    literal, start = _raw(jvm_pattern(pattern, choices)), _literal_start(pattern)
    found = f"regexp_extract_all(t, {literal}, 1)"
    guard = f"contains(t, {_quoted(start)}) AND " if start else ""
    return f"CASE WHEN {guard}t RLIKE {literal} THEN {found if every else f'try_element_at({found}, -1)'} END"


def _shared_marker(pattern: str) -> str:
    """The marker used to skip a run of neighbouring patterns in one test."""
    start = _literal_start(pattern)
    return "答案" if "答案" in start else start


def _cascade(patterns: Sequence[str], choices: Sequence[str], every: bool = False) -> str:
    """Patterns in order as SQL over ``t``: the last match of the first that matches.

    Neighbours with one marker sit behind one plain-text test.  Runs keep the
    priority order; a response without the marker skips the run.  ``every`` gives
    all matches instead of the last.
    """
    runs: list[tuple[str, list[str]]] = []
    for pattern in dict.fromkeys(patterns):
        marker = _shared_marker(pattern)
        if runs and marker and runs[-1][0] == marker:
            runs[-1][1].append(pattern)
        else:
            runs.append((marker, [pattern]))
    steps = []
    for marker, members in runs:
        step = "coalesce(" + ", ".join(_attempt(p, choices, every) for p in members) + ")"
        steps.append(f"CASE WHEN contains(t, {_quoted(marker)}) THEN {step} END" if len(members) > 1 and marker else step)
    return "coalesce(" + ", ".join(steps) + ")"


def _bound_sql(text: Column, body: str) -> Column:
    """``text.bound`` for a body written in SQL over ``t``: a long cascade is parsed
    in one call instead of being put together from a thousand."""
    return F.call_function("transform", F.array(text), F.expr(f"t -> {body}"))[0]


def convert_patterns(patterns: Sequence[str], script: Script | None) -> list[str]:
    """Patterns rewritten for simplified text, once, on the driver."""
    return [script.text(p) for p in patterns] if script else list(patterns)


def leading_choice(text: Column, choices: Sequence[str] = CHOICES) -> Column:
    """The first character, if it is an answer letter; else null."""
    first = F.substring(text, 1, 1)
    return F.when(first.isin(*choices), first)


def _letters(choices: Sequence[str]) -> str:
    return ", ".join(map(_quoted, choices))


def all_choices(
    text: Column,
    patterns: Sequence[str] = fixed.CASCADE,
    choices: Sequence[str] = CHOICES,
    script: Script | None = None,
) -> Column:
    """Every match of the deciding pattern, as an array; null if none matches."""
    body = _cascade(convert_patterns(patterns, script), choices, every=True)
    return _bound_sql(text, f"CASE WHEN left(t, 1) IN ({_letters(choices)}) THEN array(left(t, 1)) ELSE {body} END")


def last_choice(
    text: Column,
    patterns: Sequence[str] = fixed.CASCADE,
    choices: Sequence[str] = CHOICES,
    script: Script | None = None,
) -> Column:
    """The extracted answer: leading letter, else the last match of the cascade.

    A response without any answer letter skips the cascade if every pattern
    captures one.
    """
    body = _cascade(convert_patterns(patterns, script), choices)
    letter = "true"
    if all("([A-D])" in p for p in patterns):
        letter = " OR ".join(f"contains(t, {_quoted(c)})" for c in choices)
    return _bound_sql(text, f"CASE WHEN left(t, 1) IN ({_letters(choices)}) THEN left(t, 1) WHEN {letter} THEN {body} END")


def loose_choice(text: Column, choices: Sequence[str] = CHOICES, script: Script | None = None) -> Column:
    """The same with the loose patterns first."""
    return last_choice(text, fixed.LOOSE_FIRST, choices, script)


def worked_choice(text: Column, simplified: bool = False) -> Column:
    """Answer of a worked response: the text captured after a closing marker."""
    patterns = fixed.COT_SIMPLIFIED if simplified else fixed.COT_TRADITIONAL
    return _bound_sql(text, _cascade(patterns, CHOICES))


def loose_then_worked(text: Column, simplified: bool = False, script: Script | None = None) -> Column:
    """Loose cascade, then the first three worked-answer markers as fallback."""
    patterns = (fixed.COT_SIMPLIFIED if simplified else fixed.COT_TRADITIONAL)[:3]
    loose = loose_choice(text, CHOICES, script if simplified else None)
    return F.coalesce(loose, _bound_sql(text, _cascade(patterns, CHOICES)))


def judge_label(reply: Column) -> Column:
    """A judge's reply as a label: trimmed, missing reply as empty text."""
    return strip(text_or_empty(reply))

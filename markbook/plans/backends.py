"""Backends as policy records: prompt style, few-shot rule, rendering, scoring."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Backend:
    """How one family of models is prompted and marked.

    style     messages | pairs | base | instruct: the shape of a question
    few_shot  all | first_only: which worked examples are kept
    render    chat | messages | turns | lines | segments | pairs | text
    shot_rule scoring policy with examples; without them it is always zero_shot
    reads     text | scores | summed_scores: what the model's reply holds
    judge     whether replies may be marked by a judge model
    """

    name: str
    style: str = "messages"
    few_shot: str = "all"
    render: str = "messages"
    shot_rule: str = "few_shot"
    reads: str = "text"
    judge: bool = False
    direct: bool = False
    resend_folded: bool = False


BACKENDS = {
    b.name: b
    for b in (
        Backend("tgi", render="chat", judge=True),
        Backend("groq"),
        Backend("together"),
        Backend("chatgpt", few_shot="first_only", shot_rule="zero_shot", judge=True, resend_folded=True),
        Backend("azure", few_shot="first_only"),
        Backend("oai_complete", render="lines", shot_rule="exact_only", judge=True),
        Backend("claude", render="turns", judge=True, direct=True),
        Backend("gemini", render="segments", judge=True),
        Backend("dashscope", render="lines"),
        Backend("reka", render="lines"),
        Backend("hf_chat", style="pairs", render="pairs", shot_rule="zero_shot", judge=True),
        Backend("hf_base", style="base", render="text", reads="scores"),
        Backend("mixtral", style="instruct", render="text", reads="summed_scores"),
        Backend("breeze", few_shot="first_only", shot_rule="judge", judge=True),
    )
}

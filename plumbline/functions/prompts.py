"""Judge prompts of the published pairwise comparison protocol (arXiv:2306.05685)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: System prompts of the published protocol; fixed values. The second one is for items with earlier turns.
SYSTEM_PROMPT = (
    "Please act as an impartial judge and evaluate the quality of the responses provided by two AI assistants to the user "
    "question displayed below. You should choose the assistant that follows the user's instructions and answers the user's "
    "question better. Your evaluation should consider factors such as the helpfulness, relevance, accuracy, depth, "
    "creativity, and level of detail of their responses. Begin your evaluation by comparing the two responses and provide a "
    "short explanation. Avoid any position biases and ensure that the order in which the responses were presented does not "
    "influence your decision. Do not allow the length of the responses to influence your evaluation. Do not favor certain "
    "names of the assistants. Be as objective as possible. After providing your explanation, output your final verdict by "
    "strictly following this format: \"[[A]]\" if assistant A is better, \"[[B]]\" if assistant B is better, and \"[[C]]\" for a tie.")
MULTI_TURN_SYSTEM_PROMPT = (
    "Please act as an impartial judge and evaluate the quality of the responses provided by two AI assistants to the user "
    "questions. You should choose the assistant that follows the user's instructions and answers the user's questions "
    "better. Your evaluation should consider factors such as the helpfulness, relevance, accuracy, depth, creativity, and "
    "level of detail of their responses. You should focus on who provides a better answer to the second user question. "
    "Begin your evaluation by comparing the responses of the two assistants and provide a short explanation. Avoid any "
    "position biases and ensure that the order in which the responses were presented does not influence your decision. Do "
    "not allow the length of the responses to influence your evaluation. Do not favor certain names of the assistants. Be "
    "as objective as possible. After providing your explanation, output your final verdict by strictly following this "
    "format: \"[[A]]\" if assistant A is better, \"[[B]]\" if assistant B is better, and \"[[C]]\" for a tie.")


def _has_turns(context: Column) -> Column:
    return F.coalesce(F.size(context) > 0, F.lit(False))


def system_prompt(context_a: Column, context_b: Column) -> Column:
    return F.when(_has_turns(context_a) | _has_turns(context_b), F.lit(MULTI_TURN_SYSTEM_PROMPT)).otherwise(F.lit(SYSTEM_PROMPT))


def _single(prompt: Column, a: Column, b: Column) -> Column:
    return F.concat(
        F.lit("[User Question]\n"), prompt, F.lit("\n\n[The Start of Assistant A's Answer]\n"), a,
        F.lit("\n[The End of Assistant A's Answer]\n\n[The Start of Assistant B's Answer]\n"), b,
        F.lit("\n[The End of Assistant B's Answer]"))


def _side(label: str, context: Column, prompt: Column, response: Column) -> Column:
    earlier = F.transform(F.coalesce(context, F.array().cast("array<struct<role:string,text:string>>")), lambda t: F.concat(
        F.lit("### "), F.when(t["role"] == "user", F.lit("User")).otherwise(F.lit(f"Assistant {label}")), F.lit(":\n"), t["text"], F.lit("\n")))
    lines = F.concat(
        F.array(F.lit(f"<|The Start of Assistant {label}'s Conversation with User|>"), F.lit("")), earlier,
        F.array(F.concat(F.lit("### User:\n"), prompt, F.lit("\n")), F.concat(F.lit(f"### Assistant {label}:\n"), response, F.lit("\n")),
                F.lit(f"<|The End of Assistant {label}'s Conversation with User|>")))
    return F.array_join(lines, "\n")


def user_prompt(prompt: Column, response_a: Column, response_b: Column, context_a: Column, context_b: Column) -> Column:
    """What the judge is shown: both answers, and each side's own earlier turns if either has any."""
    multi = F.concat(_side("A", context_a, prompt, response_a), F.lit("\n\n\n"), _side("B", context_b, prompt, response_b))
    return F.when(_has_turns(context_a) | _has_turns(context_b), multi).otherwise(_single(prompt, response_a, response_b))

"""Prompts for language-model scorers, built from columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def numbered(contexts: Column) -> Column:
    """``[1] ...`` lines of an array of passages."""
    return F.array_join(F.transform(contexts, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c)), "\n")


def answer_prompt(question: Column, contexts: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\nContexts:\n"), numbered(contexts))


#: How a question on each type of item is best put.
ITEM_HINTS = {
    "Obligation": "ask for the duty and its deadline",
    "Prohibition": "ask what is forbidden and what is excepted",
    "Permission": "ask what is allowed and on which conditions",
    "Definition": "ask for the criteria of the term",
    "Scope": "ask to whom and when it applies",
    "Procedure": "ask for the steps and their order",
}


def item_hint(source_type: Column, target_type: Column) -> Column:
    """The hint for the target's type, with that for the source's where there is one; null for other types."""
    hints = F.create_map(*[F.lit(x) for pair in ITEM_HINTS.items() for x in pair])
    of = lambda kind: F.try_element_at(hints, F.coalesce(kind, F.lit("Other")))
    source = F.when(of(source_type).isNotNull(), F.concat(F.lit(" (first passage: "), of(source_type), F.lit(")")))
    return F.concat(F.lit("Form: "), of(target_type), F.coalesce(source, F.lit("")))


def span_rule(span_mode: Column) -> Column:
    """What the answer owes to the spans: structured ones are quoted, free-form ones are not, none asks for nothing."""
    return (
        F.when(span_mode == "structured", "The answer names every date, amount, duration, share, term and section of the spans.")
        .when(span_mode == "freeform-only", "The spans are free text: answer briefly and do not copy them.")
        .otherwise("There are no spans: answer briefly.")
    )


def dual_anchor_rule(span_mode: Column, dual_anchor: str) -> Column:
    """``off``, ``freeform_only`` or ``always``: whether each question must hang on one element of either passage; else null."""
    wanted = F.lit(True) if dual_anchor == "always" else (span_mode == "freeform-only") if dual_anchor == "freeform_only" else F.lit(False)
    return F.when(wanted, "Each question hangs on one element of either passage; without one of them it cannot be answered.")


def generation_prompt(
    persona: Column, source_id: Column, source: Column, target_id: Column, target: Column, hints: Column,
    source_type: Column | None = None, target_type: Column | None = None, span_mode: Column | None = None, dual_anchor: str = "off", citations: bool = True,
) -> Column:
    """Asks for questions that need both passages, answered with their tags; rules that do not apply are left out."""
    none = F.lit(None).cast("string")
    rules = F.concat_ws(
        "\n",
        item_hint(source_type if source_type is not None else none, target_type) if target_type is not None else none,
        span_rule(span_mode) if span_mode is not None else none,
        dual_anchor_rule(span_mode if span_mode is not None else F.lit("none"), dual_anchor),
        none if citations else F.lit("No rule or section numbers in questions or answers; the tags are no citations."),
    )
    return F.concat(
        F.lit("Persona: "), persona, F.lit("\nPassage [#SRC:"), source_id.cast("string"), F.lit("]: "), source, F.lit("\nPassage [#TGT:"), target_id.cast("string"), F.lit("]: "), target,
        F.lit("\nWords of the first passage alone: "), F.array_join(hints, ", "), F.when(rules != "", F.concat(F.lit("\n"), rules)).otherwise(""),
        F.lit("\nAsk what only both passages answer; tag each claim of the answer with its passage. Reply in JSON."),
    )


def extraction_prompt(title: Column, text: Column) -> Column:
    """Asks for the typed items of a passage as JSON."""
    return F.concat(
        F.lit("List the items of the passage: type (" + ", ".join(ITEM_HINTS) + ", Other), hook, citation and up to three spans with start and end. Reply in JSON.\nTitle: "),
        F.coalesce(title, F.lit("")), F.lit("\nPassage: "), text,
    )


def answer_judge_prompt(question: Column, gold: Column, answer: Column) -> Column:
    """Asks for answer_relevance and answer_faithfulness, whole numbers from 0 to 5, as JSON; null where gold or answer is empty."""
    asked = F.concat(
        F.lit("Rate the answer from 0 to 5 on answer_relevance (does it answer the question?) and answer_faithfulness (does it say what the reference says?). Reply in JSON.\nQuestion: "),
        question, F.lit("\nReference: "), gold, F.lit("\nAnswer: "), answer,
    )
    return F.when((F.coalesce(gold, F.lit("")) != "") & (F.coalesce(answer, F.lit("")) != ""), asked)


def judge_prompt(question: Column, answer: Column, source: Column, target: Column, threshold: int = 7) -> Column:
    """Asks for a verdict as JSON with passed, final_score and three subscores."""
    return F.concat(
        F.lit(f"Judge the pair on realism, use of both passages and correctness; pass from {threshold} points on.\nQuestion: "), question, F.lit("\nAnswer: "), answer,
        F.lit("\nFirst passage: "), source, F.lit("\nSecond passage: "), target,
    )

"""Prompts, training text and chat rendering over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillhouse import fixed
from stillhouse.functions.metrics import div
from stillhouse.functions.prompts import CHAT, CHATML, GENERATION, ChatMarkup, PromptTemplate
from stillhouse.functions.text import is_error
from stillhouse.operators.attempts import work_list

#: Turns that are put together at once.
PIECE_TURNS = 256


def generation_prompts(
    problems: DataFrame, teachers: list[str], template: PromptTemplate = GENERATION
) -> DataFrame:
    """One prompt per teacher and problem, tagged with the teacher."""
    work = work_list(problems.select("idx", "question"), teachers)
    return work.select("teacher", "idx", template.render(F.col("question")).alias("prompt"))


def evaluation_prompts(
    problems: DataFrame, template: PromptTemplate = CHAT, markup: ChatMarkup = CHATML
) -> DataFrame:
    """User prompt and the chat text a model is asked to continue."""
    prompted = problems.select("idx", template.render(F.col("question")).alias("user"))
    return prompted.select("idx", "user", markup.inference_text(F.col("user")).alias("chat"))


def training_pairs(
    problems: DataFrame,
    completions: DataFrame,
    labels: list[str],
    original: str,
    drop_errors: bool = True,
) -> DataFrame:
    """``teacher, idx, question, target`` for the chosen variants.

    The original variant learns from the problem's own answer, the others from a teacher's.
    The label filter prunes the teacher partitions of the completions.
    """
    taught = completions.where(F.col("teacher").isin([t for t in labels if t != original])).select(
        "teacher", "idx", "question", F.col("synthetic_answer").alias("target")
    )
    if drop_errors:
        taught = taught.where(~is_error(F.col("target"), fixed.ERROR_MARK))
    if original not in labels:
        return taught
    own = problems.select(
        F.lit(original).alias("teacher"), "idx", "question", F.col("answer").alias("target")
    )
    return taught.unionByName(own)


def training_text(
    pairs: DataFrame, template: PromptTemplate = CHAT, markup: ChatMarkup = CHATML
) -> DataFrame:
    """``teacher, idx, text``: a narrow projection, everything else is dropped."""
    user = template.render(F.col("question"))
    return pairs.select("teacher", "idx", markup.training_text(user, F.col("target")).alias("text"))


def conversations_text(
    turns: DataFrame, markup: ChatMarkup = CHATML, piece_turns: int = PIECE_TURNS
) -> DataFrame:
    """``conv_id, turns, text``: a table of turns rendered as one text per conversation.

    Turns are put together in pieces by ``(conv_id, piece)`` first, so one endless conversation
    is sorted by many tasks and its last step only joins finished pieces. Rows without a turn
    come first, by role and text; NULL roles and texts are empty.
    """
    piece = F.coalesce(div(F.col("turn"), piece_turns), F.lit(-1)).alias("_piece")
    text = markup.turn(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    rendered = turns.select("conv_id", piece, "turn", text.alias("text"))

    def in_order(key: str):
        ordered = F.array_sort(F.collect_list(F.struct(key, "text")))
        return F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias("text")

    pieces = rendered.groupBy("conv_id", "_piece").agg(
        F.count("*").alias("turns"), in_order("turn")
    )
    return pieces.groupBy("conv_id").agg(F.sum("turns").alias("turns"), in_order("_piece"))


def side_by_side(completions: DataFrame, teachers: list[str]) -> DataFrame:
    """One row per problem with each teacher's answer in its own column.

    The answers to a problem lie in different files, so summing up before the shuffle would sort
    all texts and merge none; they are brought together first.
    """
    return (
        completions.repartition("idx")
        .groupBy("idx")
        .pivot("teacher", teachers)
        .agg(F.first("synthetic_answer", ignorenulls=True))
    )

"""Prompt texts and chat rendering."""

from pyspark.sql import functions as F

from stillhouse.functions import prompts as P
from stillhouse.functions import text as X
from stillhouse.operators import chat


def _one(spark, expression):
    return spark.range(1).select(expression).first()[0]


def test_presets(spark):
    question = F.lit("100% of {x}?")
    ask = "Show your reasoning clearly. End with the final numerical answer after '####'."
    assert _one(spark, P.GENERATION.render(question)) == (
        f"Solve this grade school math problem step by step. {ask}\n\nProblem: 100% of {{x}}?"
        "\n\nSolution:"
    )
    assert _one(spark, P.CHAT.render(question)) == (
        f"Solve this grade school math problem step by step. {ask}\n\n100% of {{x}}?"
    )
    assert _one(spark, P.SHORT_TRAIN.render(question)) == (
        "Solve this math problem step by step:\n\n100% of {x}?"
    )
    assert _one(spark, P.SHORT_EVAL.render(question)) == (
        f"Solve this math problem step by step. {ask}\n\n Problem: 100% of {{x}}?"
    )


def test_markup(spark):
    user, reply = F.lit("Q"), F.lit("A")
    text = "<|im_start|>user\nQ<|im_end|>\n<|im_start|>assistant\nA<|im_end|>\n"
    assert _one(spark, P.CHATML.training_text(user, reply)) == text
    assert _one(spark, P.CHATML.messages_text(P.training_messages(user, reply))) == text
    assert _one(spark, P.CHATML.inference_text(user)) == (
        "<|im_start|>user\nQ<|im_end|>\n<|im_start|>assistant\n"
    )
    plain = P.ChatMarkup(open_before="[", open_after="] ", close="\n", system="Be brief.")
    assert _one(spark, plain.training_text(user, reply)) == (
        "[system] Be brief.\n[user] Q\n[assistant] A\n"
    )
    assert _one(spark, plain.messages_text(F.array(P.user_message(user)), True)) == (
        "[system] Be brief.\n[user] Q\n[assistant] "
    )


def test_strip_prompt(spark):
    rows = [("ask: 5", "ask:"), ("other 5 ", "ask:"), ("ask:", "ask:")]
    frame = spark.createDataFrame(rows, "raw string, prompt string").coalesce(1)
    got = frame.select(X.strip_prompt(F.col("raw"), F.col("prompt"))).collect()
    assert [r[0] for r in got] == ["5", "other 5", ""]


def test_long_conversation_in_pieces(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(500)]
    rows += [(2, 0, "system", "s"), (2, 1, "user", "u")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    pieces = {r["conv_id"]: r for r in chat.conversations_text(turns.repartition(7), piece_turns=8).collect()}
    for conv in (1, 2):
        want = "".join(
            f"<|im_start|>{role}\n{text}<|im_end|>\n" for c, _, role, text in rows if c == conv
        )
        assert pieces[conv]["text"] == want
        assert pieces[conv]["turns"] == sum(c == conv for c, *_ in rows)


def test_turns_and_texts_that_are_null(spark):
    rows = [(1, 2, "user", "b"), (1, None, "user", "a"), (1, 0, None, None), (2, None, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: (r["turns"], r["text"]) for r in chat.conversations_text(turns).collect()}
    head, end = "<|im_start|>", "<|im_end|>\n"
    assert got == {
        1: (3, f"{head}user\na{end}{head}\n{end}{head}user\nb{end}"),
        2: (1, f"{head}user\n{end}"),
    }


def test_training_pairs_choices(spark):
    problems = spark.createDataFrame(
        [(0, "q0", "a0"), (1, "q1", "a1")], "idx bigint, question string, answer string"
    )
    completions = spark.createDataFrame(
        [(0, "q0", "a0", "s0", "gpt"), (1, "q1", "a1", "ERROR: x", "gpt"), (0, "q0", "a0", "d0", "deepseek")],
        "idx bigint, question string, answer string, synthetic_answer string, teacher string",
    )

    def targets(labels, **options):
        pairs = chat.training_pairs(problems, completions, labels, "original", **options)
        return sorted((r["teacher"], r["target"]) for r in pairs.collect())

    assert targets(["gpt"]) == [("gpt", "s0")]
    assert targets(["gpt"], drop_errors=False) == [("gpt", "ERROR: x"), ("gpt", "s0")]
    assert targets(["original"]) == [("original", "a0"), ("original", "a1")]
    assert len(targets(["gpt", "deepseek", "original"])) == 4

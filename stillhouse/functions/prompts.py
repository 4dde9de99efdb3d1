"""Prompt texts and chat markup as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from stillhouse import fixed


@dataclass(frozen=True)
class PromptTemplate:
    """Text around a question. ``concat`` keeps ``%`` and braces in questions harmless."""

    before: str
    after: str = ""

    def render(self, question: Column) -> Column:
        parts = [F.lit(self.before), question]
        if self.after:
            parts.append(F.lit(self.after))
        return F.concat(*parts)


GENERATION = PromptTemplate(fixed.INSTRUCTION + "\n\nProblem: ", "\n\nSolution:")
CHAT = PromptTemplate(fixed.INSTRUCTION + "\n\n")
SHORT_TRAIN = PromptTemplate(fixed.SHORT_INSTRUCTION + "\n\n")
SHORT_EVAL = PromptTemplate(fixed.SHORT_EVAL_INSTRUCTION + "\n\n Problem: ")


@dataclass(frozen=True)
class ChatMarkup:
    """Turn markers of a chat format. The defaults are the public ChatML markers."""

    open_before: str = "<|im_start|>"
    open_after: str = "\n"
    close: str = fixed.END_OF_TURN + "\n"
    system: str | None = None

    def turn(self, role: Column, content: Column) -> Column:
        return F.concat(
            F.lit(self.open_before), role, F.lit(self.open_after), content, F.lit(self.close)
        )

    def _fixed_turn(self, role: str, content: Column) -> list[Column]:
        opening = F.lit(f"{self.open_before}{role}{self.open_after}")
        return [opening, content, F.lit(self.close)]

    def _system(self) -> list[Column]:
        return self._fixed_turn("system", F.lit(self.system)) if self.system is not None else []

    def training_text(self, user: Column, assistant: Column) -> Column:
        """A finished user and assistant exchange as one text."""
        return F.concat(
            *self._system(),
            *self._fixed_turn("user", user),
            *self._fixed_turn("assistant", assistant),
        )

    def inference_text(self, user: Column) -> Column:
        """The user turn followed by an assistant turn left open."""
        return F.concat(
            *self._system(),
            *self._fixed_turn("user", user),
            F.lit(f"{self.open_before}assistant{self.open_after}"),
        )

    def messages_text(self, messages: Column, open_assistant: bool = False) -> Column:
        """An ``ARRAY<STRUCT<role, content>>`` column as one text."""
        turns = F.transform(messages, lambda m: self.turn(m["role"], m["content"]))
        tail = [F.lit(f"{self.open_before}assistant{self.open_after}")] if open_assistant else []
        head = [F.concat(*self._system())] if self.system is not None else []
        return F.concat(*head, F.array_join(turns, ""), *tail)


CHATML = ChatMarkup()


def user_message(content: Column) -> Column:
    return F.struct(F.lit("user").alias("role"), content.alias("content"))


def assistant_message(content: Column) -> Column:
    return F.struct(F.lit("assistant").alias("role"), content.alias("content"))


def training_messages(user: Column, assistant: Column) -> Column:
    return F.array(user_message(user), assistant_message(assistant))

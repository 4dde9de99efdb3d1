"""Driver-side settings of the three jobs."""

from __future__ import annotations

from dataclasses import dataclass, field

from stillhouse import fixed


@dataclass(frozen=True)
class TeacherConfig:
    teachers: tuple[str, ...] = fixed.TEACHERS
    models: dict[str, str] = field(default_factory=lambda: dict(fixed.TEACHER_MODELS))
    #: label of the variant that learns from the problem set's own answers
    original: str = "original"
    original_model: str = "Original answers"
    base: str = fixed.BASE

    def model_names(self) -> dict[str, str]:
        return {**self.models, self.original: self.original_model}

    def for_evaluation(self, choice: str) -> list[str]:
        """Models an evaluation choice stands for: ``base``, ``all`` or one label."""
        if choice == "all":
            return [self.base, *self.teachers, self.original]
        return self._one(choice, {self.base, self.original, *self.teachers})

    def for_training(self, choice: str) -> list[str]:
        """Variants a training choice stands for; the base model is never trained."""
        if choice == "all":
            return [*self.teachers, self.original]
        return self._one(choice, {self.original, *self.teachers})

    @staticmethod
    def _one(choice: str, known: set[str]) -> list[str]:
        if choice not in known:
            raise ValueError(f"unknown choice {choice!r}, expected 'all' or one of {sorted(known)}")
        return [choice]


@dataclass(frozen=True)
class TrainingConfig:
    student_model: str = fixed.STUDENT_MODEL
    batch_size: int = fixed.BATCH_SIZE
    gradient_accumulation_steps: int = fixed.ACCUMULATION_STEPS
    learning_rate: float = fixed.LEARNING_RATE
    num_epochs: int = fixed.EPOCHS
    max_seq_length: int = fixed.MAX_SEQ_LENGTH
    lora_r: int = fixed.LORA_R
    lora_alpha: int = fixed.LORA_ALPHA
    lora_dropout: float = fixed.LORA_DROPOUT


@dataclass(frozen=True)
class EvalConfig:
    #: rows of the test set that are graded, by index; None is the whole set
    test_size: int | None = None
    sample_rows: int = fixed.SAMPLE_ROWS
    sample_chars: int = fixed.SAMPLE_CHARS


@dataclass(frozen=True)
class BreakerConfig:
    block_rows: int = fixed.BLOCK_ROWS
    block_error_rate: float = fixed.BLOCK_ERROR_RATE
    max_consecutive: int = fixed.MAX_CONSECUTIVE_ERRORS


@dataclass(frozen=True)
class RetryConfig:
    max_tries: int = fixed.MAX_TRIES
    first_delay_s: float = fixed.FIRST_DELAY_S
    rate_limit_factor: int = fixed.RATE_LIMIT_FACTOR
    other_factor: int = fixed.OTHER_FACTOR

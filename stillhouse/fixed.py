"""Texts, patterns, labels and limits that decide results."""

# --- prompts -------------------------------------------------------------
INSTRUCTION = (
    "Solve this grade school math problem step by step. Show your reasoning clearly. "
    "End with the final numerical answer after '####'."
)
SHORT_INSTRUCTION = "Solve this math problem step by step:"
SHORT_EVAL_INSTRUCTION = (
    "Solve this math problem step by step. Show your reasoning clearly. "
    "End with the final numerical answer after '####'."
)

# --- numbers in text -----------------------------------------------------
ANSWER_MARK = "####"
NUMBER = r"-?\d+(?:,\d{3})*(?:\.\d+)?"
PLAIN_NUMBER = r"-?\d+\.?\d*"

# --- failures ------------------------------------------------------------
ERROR_MARK = "ERROR:"
RATE_LIMIT_WORDS = ("429", "rate limit", "quota")
MAX_TRIES = 5
FIRST_DELAY_S = 2.0
RATE_LIMIT_FACTOR = 3
OTHER_FACTOR = 2

# --- circuit breaker and progress ---------------------------------------
BLOCK_ROWS = 100
BLOCK_ERROR_RATE = 0.5
MAX_CONSECUTIVE_ERRORS = 10

# --- evaluation ----------------------------------------------------------
BASE = "base"
BASE_LABEL = "BASE (no fine-tuning)"
ACCURACY_DIGITS = 4
SAMPLE_ROWS = 5
SAMPLE_CHARS = 500
TEST_ROWS = 1319
SEED = 42

# --- teachers and models -------------------------------------------------
TEACHERS = ("gpt", "deepseek", "gemini")
TEACHER_MODELS = {
    "gpt": "gpt-4o-mini",
    "deepseek": "deepseek-chat",
    "gemini": "gemini-2.0-flash",
}
STUDENT_MODEL = "Qwen/Qwen2.5-1.5B-Instruct"
TRAINABLE_PARAMS = 73_859_072
TOTAL_PARAMS = 962_475_520

# --- training ------------------------------------------------------------
BATCH_SIZE = 4
ACCUMULATION_STEPS = 4
LEARNING_RATE = 1e-5
EPOCHS = 2
MAX_SEQ_LENGTH = 512
LORA_R = 64
LORA_ALPHA = 128
LORA_DROPOUT = 0.08
END_OF_TURN = "<|im_end|>"

"""Fixed values that results depend on."""

# --- fixed values: special tokens; the position is the token id ---------------
SPECIAL_TOKENS = (
    "<|bos|>",
    "<|user_start|>",
    "<|user_end|>",
    "<|assistant_start|>",
    "<|assistant_end|>",
    "<|python_start|>",
    "<|python_end|>",
    "<|output_start|>",
    "<|output_end|>",
)

# --- fixed value: pre-token split pattern -------------------------------------
SPLIT_PATTERN = (
    r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}"
    r"| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"
)

# --- fixed values: corpus shards ----------------------------------------------
SHARD_NAME_FORMAT = "shard_%05d.parquet"
MAX_SHARDS = 1823

# --- fixed values: vocabulary training defaults --------------------------------
DEFAULT_VOCAB_SIZE = 32768
DEFAULT_DOC_CAP = 10_000
DEFAULT_MAX_CHARS = 10_000_000_000

# --- fixed values: evaluation ---------------------------------------------------
SHUFFLE_SEED = 1337
FEWSHOT_SEED = 1234
DEFAULT_DELIMITER = " "
TOTAL_LABEL = "CORE"
IGNORE_INDEX = -1
LOGIT_SOFTCAP = 15.0

# --- fixed values: run log ------------------------------------------------------
EVAL_EVERY = 250
EMA_BETA = 0.9
WARMUP_STEPS = 10
PEAK_FLOPS = 989e12
TOKENS_PER_STEP = 524_288

# --- fixed value: longest rendered conversation ---------------------------------
MAX_RENDERED_TOKENS = 2048

# --- fixed values: calculator tool ----------------------------------------------
MATH_CHARS = "0123456789*+-/.() "
TEXT_CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789'\"()._ "
BLOCKED_WORDS = (
    "__", "import", "exec", "eval", "compile", "open", "file",
    "input", "raw_input", "globals", "locals", "vars", "dir",
    "getattr", "setattr", "delattr", "hasattr",
)
REQUIRED_CALL = ".count("


def special_id(name: str) -> int:
    """Id of a special token by exact name."""
    return SPECIAL_TOKENS.index(name)


BOS = special_id("<|bos|>")
USER_START = special_id("<|user_start|>")
USER_END = special_id("<|user_end|>")
ASSISTANT_START = special_id("<|assistant_start|>")
ASSISTANT_END = special_id("<|assistant_end|>")
PYTHON_START = special_id("<|python_start|>")
PYTHON_END = special_id("<|python_end|>")
OUTPUT_START = special_id("<|output_start|>")
OUTPUT_END = special_id("<|output_end|>")

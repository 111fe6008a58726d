"""Column types and fixed texts shared by the whole package."""

from pyspark.sql import types as T

MESSAGE = T.StructType(
    [T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]
)
MESSAGES = T.ArrayType(MESSAGE)

# The chat markup, the texts the converters write, and the class
# lists used when a task names none.
TURN_OPEN = "<|im_start|>"
TURN_CLOSE = "<|im_end|>"
ANSWER_OPEN = "<|im_start|>assistant\n"
CVE_SYSTEM = (
    "You are a cybersecurity expert specializing in CVE analysis. Given a CVE "
    "description, provide the severity level (CRITICAL, HIGH, MEDIUM, LOW) and a "
    "brief risk summary."
)
CVE_UNRATED = "MEDIUM. Requires further analysis."
HELPER_SYSTEM = "You are a helpful assistant."
BINARY_CLASSES = ("ANOMALY", "NORMAL")
MULTICLASS_CLASSES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
PROMPT_TOKENS = 1024
TRAINING_TOKENS = {"accuracy": 2048, "balanced": 1024, "latency": 512}
WARMUP_RUNS = 3
TOKENS_PER_RUN = 32
LOSS_GAP = 0.1
FP16_BYTES = 2.0
INT4_BYTES = 0.6

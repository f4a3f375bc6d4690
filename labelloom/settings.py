"""Fixed values and default parameters shared by every operator."""

# Label domain: raw annotation -> class id, and the class names in id order.
LABEL_MAP = {-1: 0, 0: 1, 1: 2}
LABEL_NAMES = ["Negative", "Neutral", "Positive"]
NUM_CLASSES = 3
RAW_LABELS = [-1, 0, 1]

# Split and fold defaults.
SEED = 42
TEST_SHARE = 0.2
FOLDS = 5

# TF-IDF defaults.
MAX_FEATURES = 10000

# Linear model defaults.
C_GRID = [0.01, 0.1, 1.0, 10.0]
MAX_ITER = 1000
FIXED_C = 1.0

# Ablation defaults.
CHI2_TOP_K = 5000
PROMOTE_DELTA = 0.001
GUARD_TERM = "छैन"

# Subword encoding and length defaults.
MAX_LENGTH = 64
LENGTH_CUTOFFS = [64, 128, 256]
LENGTH_STEP = 32
HISTOGRAM_BINS = 50
PREVIEW_CHARS = 100
BATCH_SIZE = 16

# Early stopping: epochs without improvement before training stops.
PATIENCE = 2

# Texts a pandas CSV reader treats as missing (fixed values).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

# A group of equal keys larger than this is salted before a join on the key.
HOT_GROUP_ROWS = 1_000_000

# Largest vocabulary, in bytes of term text, that is shipped to every executor.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024

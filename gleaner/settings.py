"""Defaults. Every function takes these as parameters; nothing reads the environment."""

# --- fixed values: they must equal the searched service's for equal results ---
DEFAULT_PAGE_LIMIT = 10
MAX_PAGE_LIMIT = 100
FEATURED_LIMIT = 5
TOP_K = 10
CANDIDATE_K = 30
SCORE_THRESHOLD = 0.4
VECTOR_DIM = 1024
ENCODE_BATCH = 32
OTHER_CATEGORY = "Khác"
UNKNOWN_AUTHOR = "Ẩn danh"
UNTITLED = "Không có tiêu đề"
# --- end of fixed values ---

# A side is broadcast only when rows x bytes-per-row is proven to stay below this.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024

# Query vectors shipped to the tasks in one go (32 MB at 1024 dimensions).
QUERY_BLOCK_ROWS = 4096

# A build commits its work in id slices of about so many articles.
SLICE_ROWS = 10_000_000

# Pages ending beyond this row leave the top-k plan (see operators.paging).
TOP_K_PAGE_ROWS = 100_000

SCORE_DECIMALS = 6

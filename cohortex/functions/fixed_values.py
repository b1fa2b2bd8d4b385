"""Fixed values.

These constants must equal the behaviour being reproduced, so they are
stated plainly and together here: code maps, window lengths, thresholds,
patterns and model settings. Everything else in the package is derived
from them.
"""

# --- fixed values (must match for right results) -------------------------

GENDER_CODES = {"M": 1, "F": 0}
GENDER_DEFAULT = -1

AGE_BUCKET_CODES = {
    "<18": 0, "15": 0,
    "18-24": 1, "25": 1,
    "25-34": 2, "30": 2, "35": 2,
    "35-44": 3, "40": 3, "45": 3,
    "45-54": 4, "50": 4, "55": 4,
    "55+": 5, "60": 5, "65": 5,
}
AGE_DEFAULT = -1

AMOUNT_BUCKET_VALUES = {
    "<1k": 500, "1k+": 1000, "5k+": 5000, "10k+": 10000,
    "20k+": 20000, "50k+": 50000, "100k+": 100000,
}
AMOUNT_DEFAULT = 0

# online flag values that count as "online" (the text '1' included, D8)
ONLINE_FLAG_VALUES = ["Y", "y", "1"]

# activity is measured against this constant date; NULL -> 999 days
ACTIVITY_REFERENCE_DATE = "2026-02-18"
ACTIVITY_MISSING_DAYS = 999

TX_WINDOWS = [7, 30, 90]
RECEIPT_WINDOWS = [30, 90]

SEGMENT_CODE_PATTERN = r"^([a-z]_\d{2})"
SEGMENT_RANK_PATTERN = r"\((\d+)\)"

ACTIVE_ACCOUNT_STATUS = "ACT"

ACTIVATION_CONFIDENCE = 1.0
REWARD_CONFIDENCE = 2.0

HOLDOUT_SHARE = 0.2
HOLDOUT_SEED = 42

PSI_BUCKETS = 10
PSI_THRESHOLD = 0.5
DRIFT_SHARE_LIMIT = 0.01
DRIFT_MEAN_LIMIT = 0.1

ALS_RANK = 64
ALS_MAX_ITER = 5
ALS_REG = 0.1
ALS_ALPHA = 1.0
ALS_SEED = 42
TOP_N_DEFAULT = 100
MAX_AUDIENCE = 1000

TABLE_NAMES = [
    "people", "segments", "transaction", "offer", "merchant",
    "financial_account", "offer_seens", "offer_activation",
    "offer_reward", "receipts",
]
COMPLETE_VERSION_TABLES = ["people", "transaction", "offer", "merchant"]

"""Constants that decide results and therefore have to be exactly these."""

# Names that never enter a roster.
DENIED_ROSTER_NAMES = ["Various", "Various Artists"]
DENIED_MODEL_NAMES = ["Daft Punk"]

# Alias sentinels that mean "no profile".
ALIAS_SENTINELS = ["x", "No Soundcloud Found"]
ALIAS_NOT_FOUND = "No Soundcloud Found"

# Legitimacy rule.
PAID_PLANS = ["Pro", "Pro Plus"]
MIN_FOLLOWERS = 500

# Profile addresses.
PROFILE_SCHEME = "https:"
PROFILE_HOST = "soundcloud.com"
PROFILE_PREFIX = "https://soundcloud.com/"
API_HOST = "api.soundcloud.com"
SEARCH_SUFFIX = "+soundcloud+page"

# Marks written into the files.
REVIEW_KEEP = "x"
NO_EXCEPTION = "no exception"
EXCEPTION_PREFIX = "Exception "

# Activity report and answer size.
ACTIVITY_THRESHOLDS = [10, 100]
ANSWER_SIZE = 30

# Live model and grid.
ALS_SETTINGS = {
    "rank": 5,
    "maxIter": 5,
    "regParam": 1.0,
    "alpha": 1.0,
    "seed": 0,
    "implicitPrefs": True,
    "nonnegative": True,
}
GRID_RANKS = [5, 10, 20]
GRID_REG_PARAMS = [0.01, 0.1, 1.0]
SPLIT_WEIGHTS = [0.8, 0.2]
SPLIT_SEED = 1

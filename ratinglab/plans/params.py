"""Parameters of the registered queries (shared by the Spark side and the SQL oracle).

The test tables' items have 11 to 53 ratings, so the reference thresholds (110, 120, 45)
would leave no trusted item; the registered queries use 30 and 28, and the functions
keep the reference values as their defaults.
"""

SEED = 42
RANK = 6
TRUSTED_MIN = 30
SAMPLE_MIN = 28
MIN_RATING = 1.0
NOISE_SD = 0.1
TRAIN_RATIO = 0.8
TEST_RATIO = 0.1
ACCEPTS = 100
MAX_ITER = 100000
STUDY_SIZES = (5, 10, 15, 20, 25)
N_USERS = 100
B = 0.5
N_PICKS = 5
RIDGE_REG = 0.2
KDE_CUTOFFS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5)
EM_BASES = 12
ALS_BLOCKS = 8  # of users; a constant: the block count changes the result
ALS_ITEM_BLOCKS = 3  # changes no result: the fewer, the less users' factors are sent
ALS_ITERATIONS = 25
ALS_REG = 0.1
ALS_SWEEPS = 2
CUTOFF = 0.4
LSH_TABLES = 40
LSH_WIDTH = 2.5
SEGMENT = "BUILDING"  # market segment of the request list

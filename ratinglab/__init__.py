"""ratinglab: rating analytics and diversified recommendation on Spark DataFrames.

Every public operator is a function ``DataFrame(s) -> DataFrame`` that stays lazy;
nothing is collected unless its size is bounded and checked first.
"""

from ratinglab.session import build_session, checkpoint_root

__all__ = ["build_session", "checkpoint_root"]

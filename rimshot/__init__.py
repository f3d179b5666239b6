"""rimshot: Spark-native season analytics for team sports.

Every operator is a lazy ``DataFrame -> DataFrame`` function built from
Spark SQL built-ins; Catalyst plans the work, so the same code runs on one
laptop core or a thousand executors.
"""

from rimshot.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]

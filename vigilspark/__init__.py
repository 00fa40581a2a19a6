"""vigilspark — log baselines, anomaly scores and deduplicated alerts as Spark jobs.

Every operator is a function ``DataFrame -> DataFrame`` built from the
DataFrame API, so Catalyst plans it and the same code runs on a laptop
(``local[8]``) or a large cluster.  See README.md for the operator map.
"""

from vigilspark.session import get_session, checkpoint_dir  # noqa: F401
from vigilspark.config import AlertRules, Threshold  # noqa: F401

__all__ = ["get_session", "checkpoint_dir", "AlertRules", "Threshold"]

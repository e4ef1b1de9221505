"""All registered queries (import order = registration order)."""

from quarry.plans import q_relational  # noqa: F401
from quarry.plans import q_analytics  # noqa: F401
from quarry.plans import q_segment  # noqa: F401
from quarry.plans import q_models  # noqa: F401
from quarry.plans import q_items  # noqa: F401
from quarry.plans import q_hard  # noqa: F401
from quarry.plans.registry import ORACLES, QUERIES  # noqa: F401


def flagship(spark, sf_dir):
    return QUERIES["c01_rfm_segments"](spark, sf_dir)

"""All registered queries."""

from markwise.plans import (  # noqa: F401
    catalog_grader,
    catalog_joins,
    catalog_mining,
    catalog_sources,
    catalog_streaming,
    catalog_text,
    catalog_training,
)
from markwise.plans.registry import ORACLES, QUERIES  # noqa: F401

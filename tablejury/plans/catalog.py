"""All registered queries."""

from tablejury.plans import (  # noqa: F401
    catalog_human,
    catalog_privacy,
    catalog_profile,
    catalog_sources,
    catalog_text,
    catalog_trials,
)
from tablejury.plans.registry import ORACLES, QUERIES  # noqa: F401

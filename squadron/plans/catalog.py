"""Imports every query module so that the registry is complete."""

from squadron.plans import (io_queries, player_queries, report_queries,  # noqa: F401
                            stats_queries, transfer_queries, weekly)
from squadron.plans.registry import REGISTRY  # noqa: F401

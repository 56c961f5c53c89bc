"""Imports every query module so that the registry is complete."""

from folioforge.plans import (  # noqa: F401
    beta_queries,
    context_queries,
    fundamental_queries,
    holding_queries,
    landed_queries,
    stored_queries,
    technical_queries,
    trade_queries,
    valuation_queries,
)
from folioforge.plans.registry import ORACLE, QUERIES  # noqa: F401

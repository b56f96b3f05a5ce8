"""All named queries; importing this package fills the registry."""

from demandgrid.catalog import (  # noqa: F401
    feature_queries,
    forecast_queries,
    model_queries,
    panel_queries,
    run_queries,
    score_queries,
    wide_queries,
)
from demandgrid.catalog.base import CATALOG

__all__ = ["CATALOG"]

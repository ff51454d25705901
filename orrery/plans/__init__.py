"""All named queries of the library, without the training-data ones."""

from orrery.plans import catalogue, domain, scalars, series, sky, statistics, streams, tables, windows  # noqa: F401
from orrery.plans.registry import ORACLES, QUERIES  # noqa: F401

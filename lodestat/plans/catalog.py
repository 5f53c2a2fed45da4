"""The query catalogue: importing the modules registers their queries."""

from lodestat.plans import budgets, evolution, inference, laws, mixture, panel, quality, records, reports  # noqa: F401
from lodestat.plans.registry import QUERIES, SQL  # noqa: F401

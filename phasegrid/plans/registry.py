"""Names of all queries on the driver's tables."""

from phasegrid.plans import file_queries  # noqa: F401  registers its own
from phasegrid.plans.queries import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "linear_rate"

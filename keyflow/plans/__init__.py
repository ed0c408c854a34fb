"""Query plans over the driver's tables."""

from keyflow.plans import live, sequences, tables  # noqa: F401  they register their queries

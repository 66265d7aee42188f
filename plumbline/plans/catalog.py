"""Registry of every query of the library outside the training-data subpackage, with its SQL."""

from plumbline.plans import oracles, queries, runs

QUERIES = queries.QUERIES | runs.QUERIES
ORACLES = oracles.ORACLES | runs.ORACLES

"""The engine's queries over the driver's tables, with SQL that says the same."""

from . import labels, logs, texts

QUERIES = labels.QUERIES | texts.QUERIES | logs.QUERIES
ORACLES = labels.ORACLES | texts.ORACLES | logs.ORACLES

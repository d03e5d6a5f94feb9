"""Registered queries over the driver's tables and the SQL that gives the same rows."""

from . import modelling, tabular

QUERIES: dict = tabular.QUERIES | modelling.QUERIES
ORACLES: dict = tabular.ORACLES | modelling.ORACLES

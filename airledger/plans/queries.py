"""All queries of the library by name."""

from . import q_chain, q_fits, q_inventory, q_readings, q_spatial, q_studies  # noqa: F401
from .registry import ORACLES, QUERIES


def queries():
    return QUERIES


def oracle_sql():
    return ORACLES

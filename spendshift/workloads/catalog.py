"""All registered queries."""

from spendshift.workloads import case, comparison, documents, knowledge, landing  # noqa: F401
from spendshift.workloads.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

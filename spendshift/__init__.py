"""Cloud-cost change analysis as Spark DataFrame operators."""

from spendshift.periods import Period
from spendshift.session import prepare

__all__ = ["Period", "prepare"]

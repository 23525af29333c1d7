"""Listing qualification on Spark: DataFrame operators over business listings."""

from .plans.brief import Brief, BriefError, validate
from .plans.judge import Inputs, judge
from .session import build_session

__all__ = ["Brief", "BriefError", "Inputs", "build_session", "judge", "validate"]

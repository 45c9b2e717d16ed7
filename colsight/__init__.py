"""colsight: data profiling as Spark DataFrame jobs."""

from colsight.config import Dialect, ProfileConfig, dialect

__all__ = ["Dialect", "ProfileConfig", "dialect"]

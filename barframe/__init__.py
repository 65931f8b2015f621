"""barframe: market time-series analytics as PySpark DataFrame operators."""

from barframe.session import get_session

__all__ = ["get_session"]

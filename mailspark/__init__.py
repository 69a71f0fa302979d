"""Message collections to a clean contacts table, as Spark jobs."""

from .config import FilterConfig

__all__ = ["FilterConfig"]

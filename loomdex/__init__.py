"""loomdex: supplier-document intelligence expressed as Spark jobs."""

from loomdex.settings import DEFAULTS, Settings

__all__ = ["DEFAULTS", "Settings"]

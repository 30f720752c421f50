

from . import family, more  # noqa: F401  (register their queries)
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

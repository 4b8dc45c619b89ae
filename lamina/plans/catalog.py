"""All queries of the engine's own operators by name, and their SQL twins."""

from __future__ import annotations

from . import fields, space  # noqa: F401  (they add their queries)
from .queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

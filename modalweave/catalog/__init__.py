"""Registered queries: each operator run over the whole given tables.

``QUERIES`` maps a name to a callable (spark, sf_dir) -> DataFrame and
``ORACLES`` to the equivalent SQL where there is one.
"""

from .common import ORACLES, QUERIES
from . import alignment, certificates, data, evaluation, geometry, scoring, vectors  # noqa: F401  (register)

__all__ = ["ORACLES", "QUERIES"]

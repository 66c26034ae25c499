"""All registered queries."""

from . import catalog_columns  # noqa: F401
from . import catalog_explore  # noqa: F401
from . import catalog_history  # noqa: F401
from . import catalog_learning  # noqa: F401
from . import catalog_models  # noqa: F401
from . import catalog_sources  # noqa: F401
from .registry import ORACLES, QUERIES

FLAGSHIP = "a14_compare_models"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]

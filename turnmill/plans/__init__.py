"""Named queries over the driver's tables, each with its SQL where SQL can express it."""

from turnmill.plans import analysis, content, evaluation, learning  # noqa: F401  (they register their queries)
from turnmill.plans.registry import QUERIES, SQL  # noqa: F401

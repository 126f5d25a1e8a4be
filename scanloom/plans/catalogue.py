"""All queries of the engine; importing the modules registers them."""

from scanloom.plans import extras, numeric, points, rooms, scores, tracks  # noqa: F401
from scanloom.plans.registry import QUERIES, SQL  # noqa: F401

"""Named queries over the views, grouped by subject; importing this package registers all of them."""

from tradewind.plans import cards, feeds, insights, leads, scores, series, storage, streaming, text, trade  # noqa: F401
from tradewind.plans.registry import QUERIES, oracles  # noqa: F401

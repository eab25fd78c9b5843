"""All registered queries (importing the modules fills the registry)."""

from tickflow.plans import market_queries  # noqa: F401
from tickflow.plans import source_queries  # noqa: F401
from tickflow.plans import event_queries  # noqa: F401
from tickflow.plans import forecast_queries  # noqa: F401
from tickflow.plans import message_queries  # noqa: F401
from tickflow.plans import workflow_queries  # noqa: F401
from tickflow.plans import stream_queries  # noqa: F401
from tickflow.plans import live_queries  # noqa: F401
from tickflow.plans.registry import REGISTRY, Query  # noqa: F401

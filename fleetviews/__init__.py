"""Topic-addressed streaming views over vehicle telemetry, alerts and commands."""

from .plans.client import FleetClient
from .plans.registry import Registry
from .plans.viewset import ViewSet
from .session import build_session, work_dir

__all__ = ["FleetClient", "Registry", "ViewSet", "build_session", "work_dir"]

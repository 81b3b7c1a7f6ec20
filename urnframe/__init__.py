"""urnframe: Spark jobs over histories of draws (ordered series of small item sets)."""

from urnframe.session import checkpoint_frame, get_session

__all__ = ["checkpoint_frame", "get_session"]
__version__ = "0.1.0"

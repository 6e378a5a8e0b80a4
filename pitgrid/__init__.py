"""Point-in-time market analytics as Spark DataFrame operators."""

from pitgrid.session import build_session, checkpoint_folder

__all__ = ["build_session", "checkpoint_folder"]

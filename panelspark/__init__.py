"""Indicator panels on Spark: landing, staging, marts, serving queries and checks."""

from .session import panel_session, pin, scratch_path, scratch_run, shared_folder

__all__ = ["panel_session", "pin", "scratch_path", "scratch_run", "shared_folder"]

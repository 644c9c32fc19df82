"""Structured Streaming runners for windowed alert jobs."""

from stratus.streaming.runner import start_window_job  # noqa: F401

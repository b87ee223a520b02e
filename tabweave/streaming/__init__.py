"""Profiles and drift of a stream, batch by batch."""

from tabweave.streaming.monitor import monitor_profile, windowed_moments

__all__ = ["monitor_profile", "windowed_moments"]

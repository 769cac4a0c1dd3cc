"""Incremental landing with Structured Streaming."""

from kairos.streaming.landing import hourly_landing_stream  # noqa: F401

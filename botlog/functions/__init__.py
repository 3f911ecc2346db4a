"""Native column expressions."""

from botlog.functions import logformat, traits

__all__ = ["logformat", "traits"]

"""Failures with a stable reason text."""


class BarError(Exception):
    """A refused request, source or output; the text is the reason."""


class RecordError(BarError):
    """A refused file, with what is known of its bad records."""

    def __init__(self, reason: str, details: dict):
        super().__init__(reason)
        self.details = details


class Cancelled(BarError):
    """The caller asked to stop."""

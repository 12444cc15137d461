"""Exceptions raised on the driver."""


class EngineError(Exception):
    """Base of all errors of this package."""


class QueryError(EngineError, ValueError):
    """The request or one of its filters is malformed."""


class SegmentError(EngineError):
    """A segment, its manifest entry or an input object is inconsistent."""

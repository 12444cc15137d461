"""chronofind: time-series metadata search expressed as Spark plans."""

__version__ = "0.1.0"

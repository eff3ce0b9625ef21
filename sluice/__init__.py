"""Sluice: streaming and batch SQL analytics expressed as Spark plans."""

__version__ = "0.1.0"

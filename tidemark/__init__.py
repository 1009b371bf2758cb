"""Point-in-time analytics over long event timelines, written as Spark DataFrame operators."""

__version__ = "0.1.0"

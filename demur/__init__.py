"""Classification with a reject option, as Spark jobs."""

__version__ = "0.1.0"

"""Analytics over very large annotated picture archives, expressed as Spark plans."""

__version__ = "0.1.0"

"""thriftlens: token-usage analytics over agent sessions, written as Spark plans."""

__version__ = "0.1.0"

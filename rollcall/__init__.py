"""rollcall: Spark-native analytics for multi-tenant event registration."""

__version__ = "0.1.0"

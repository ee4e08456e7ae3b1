"""millrace: a PySpark-native engine for packaged text, its policies, lookups and audits."""

__version__ = "0.1.0"

"""ledgerloom: PySpark-native analytics over hash-chained, signed event ledgers."""

__version__ = "0.1.0"

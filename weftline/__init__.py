"""weftline: a Spark-native analytics engine for catalogues of described, tagged entities."""

__version__ = "0.1.0"

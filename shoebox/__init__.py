"""shoebox: a PySpark-native analytics engine for photo and video catalogues."""

__version__ = "0.1.0"

"""quarry: code- and document-navigation analytics on PySpark DataFrames."""

__version__ = "0.1.0"

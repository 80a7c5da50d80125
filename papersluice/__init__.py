"""papersluice: document search, screening and change tracking as Spark DataFrame plans."""

__version__ = "0.1.0"

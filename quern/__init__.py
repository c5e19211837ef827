"""quern: document retrieval and grounded answering over Spark DataFrames."""

__version__ = "0.1.0"

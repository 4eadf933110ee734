"""tracewell: document and catalogue analytics on PySpark DataFrames.

Operators take and return DataFrames; none of them creates a session.
"""

__version__ = "0.1.0"

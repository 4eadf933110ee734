from tracewell.sources.tables import table

__all__ = ["table"]

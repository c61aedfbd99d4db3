from quipu.sources.tables import key, table

__all__ = ["key", "table"]

"""Sources and sinks of the engine."""

from weftline.sources.tables import latest_cards, table

__all__ = ["latest_cards", "table"]

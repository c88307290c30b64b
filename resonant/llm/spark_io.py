"""Tables and the shared folder, as the rest of the package reads and writes them."""

from ..sources.tables import new_place, spread_table, table, written

__all__ = ["new_place", "spread_table", "table", "written"]

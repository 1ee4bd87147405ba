"""Reading and writing tables, logs and versioned folders."""

from .package import ship_package
from .tables import interactions, items, read_table

__all__ = ["interactions", "items", "read_table", "ship_package"]

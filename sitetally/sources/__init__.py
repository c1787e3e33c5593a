"""Inputs: typed tables, raw sheet rows (positional operations), workbook ingest."""

from sitetally.sources.tables import (blank_to_null, normalise_names, read_table, rejected_cells,
                                      typed_incidents)

__all__ = ["blank_to_null", "normalise_names", "read_table", "rejected_cells", "typed_incidents"]

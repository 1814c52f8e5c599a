"""Reading input tables and writing results."""

from dosequant.sources.monthly import (
    MonthlyFiles,
    monthly_layouts,
    monthly_rejects,
    read_monthly,
)
from dosequant.sources.sinks import write_dated
from dosequant.sources.tables import (
    CsvTable,
    read_adq_sheet,
    read_csv_table,
    read_csv_text,
    unreadable_cells,
)

__all__ = [
    "CsvTable", "MonthlyFiles", "monthly_layouts", "monthly_rejects", "read_adq_sheet", "read_csv_table",
    "read_csv_text", "read_monthly", "unreadable_cells", "write_dated",
]

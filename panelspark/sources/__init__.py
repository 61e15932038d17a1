from .readers import (
    load_all, observe_counts, open_snapshots, read_panel, read_sheets, register_snapshots, snapshot_dates, snapshot_report,
)
from .sinks import publish_table, publish_view, write_snapshot

__all__ = [
    "load_all", "observe_counts", "open_snapshots", "publish_table", "publish_view", "read_panel",
    "read_sheets", "register_snapshots", "snapshot_dates", "snapshot_report", "write_snapshot",
]

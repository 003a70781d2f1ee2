"""Sources and sinks: working trees, git snapshots, flat stores, HTML views."""

"""Where snapshots and data come from."""

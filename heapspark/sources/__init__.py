"""Reading and writing of snapshots and results."""

"""Writers: lake, shards, result files, live outputs."""

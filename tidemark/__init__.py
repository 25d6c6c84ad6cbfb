"""Record-log analytics on Spark: partitioning, sequencing, indexing, scans, leases, placement."""

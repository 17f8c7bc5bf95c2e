"""Sources: catalogue tables derived from the driver's parquet, file listings, inventories."""

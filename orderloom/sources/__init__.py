"""Dataset catalog, CSV and Parquet readers, and bindings of other tables to the catalog."""

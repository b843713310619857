"""Getting raw files: a manifest of entries, the connectors, and the run over them. All of it is on the driver, before Spark reads."""

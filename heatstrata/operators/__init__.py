"""DataFrame -> DataFrame operators. Column names are parameters wherever a caller may differ."""

"""DataFrame -> DataFrame operators; all column names are parameters."""

"""DataFrame -> DataFrame operators and fit/apply pairs."""

"""DataFrame-to-DataFrame operators: filters, graph, windows, ranking, table upkeep."""

"""One-table-in, one-table-out preparation operators (fit = aggregate, apply = projection)."""

"""Plan-sheet analytics on Spark: tables in, tables out."""

"""relspark: benchmark-overlap measurement and answer-reliability analytics as Spark plans."""

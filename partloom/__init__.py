"""partloom: Spark-first analytics for engineering-part data (faces, points, labels, graphs)."""

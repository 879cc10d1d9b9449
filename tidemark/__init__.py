"""Price-move events on Spark: detect, collect what preceded them, compare."""

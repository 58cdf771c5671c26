"""arborlake: property-graph, text and evaluation analytics as PySpark DataFrame functions."""

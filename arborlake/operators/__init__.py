"""operators of arborlake."""

"""streaming of arborlake."""

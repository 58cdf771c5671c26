"""sources of arborlake."""

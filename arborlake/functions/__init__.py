"""functions of arborlake."""

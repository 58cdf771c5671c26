"""plans of arborlake."""

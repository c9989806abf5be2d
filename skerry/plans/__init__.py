"""Plan shapes that keep operators safe when one key holds a large share of all rows."""

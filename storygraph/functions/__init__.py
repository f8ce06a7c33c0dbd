"""Part of storygraph."""

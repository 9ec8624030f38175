"""Sources of frames and primitives."""

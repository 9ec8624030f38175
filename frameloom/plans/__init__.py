"""Plans of frames and primitives."""

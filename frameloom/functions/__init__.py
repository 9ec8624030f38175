"""Functions of frames and primitives."""

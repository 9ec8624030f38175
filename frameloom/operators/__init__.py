"""Operators of frames and primitives."""

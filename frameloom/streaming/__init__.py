"""Streaming of frames and primitives."""

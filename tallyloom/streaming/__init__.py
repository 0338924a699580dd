"""Piece-by-piece reading with Structured Streaming."""

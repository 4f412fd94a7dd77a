"""Colloquy: storing and searching meeting transcripts with Spark DataFrames."""

"""Spark jobs over sung-melody tables: frames, notes, words, lyrics, charts and live samples."""

"""Glyph and document analytics as Spark jobs: every operator is a lazy DataFrame -> DataFrame function."""

"""Operators on frame facts, segments, plans, edits and pixels."""

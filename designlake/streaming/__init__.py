"""The same states from streams of events."""

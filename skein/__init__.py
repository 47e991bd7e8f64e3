"""Hybrid retrieval and text analytics as plain DataFrame plans."""

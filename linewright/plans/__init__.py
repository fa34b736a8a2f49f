"""Helpers that keep plans safe at scale: size checks, hot-key splits, ranking."""

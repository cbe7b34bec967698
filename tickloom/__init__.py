"""Spark operators for windowed panels of daily price and volume series."""

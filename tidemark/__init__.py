"""Interval, event and trajectory analytics as Spark DataFrame transforms."""

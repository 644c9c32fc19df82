"""stratus — Spark-native analytics over long histories and live streams of
time-stamped observations.

Everything is a DataFrame → DataFrame function whose column names are
arguments; presets in :mod:`stratus.plans` bind them to concrete tables.
"""

__version__ = "0.1.0"

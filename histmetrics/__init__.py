"""Measured history of versioned file trees, as Spark DataFrames.

Every operator takes DataFrames (and plain parameters) and returns a
DataFrame; nothing is collected and no session is held globally.
"""

__version__ = "0.1.0"

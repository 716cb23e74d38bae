"""windowlab: Spark jobs over labelled measurement windows.

Tall metric tables become one row per window, windows are split by run, scaled,
filtered, classified and judged, and a detector trained in one domain is
examined in the other.  Everything takes and returns DataFrames.
"""

__version__ = "0.1.0"

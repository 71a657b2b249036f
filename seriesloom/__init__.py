"""Time-series table operators, feature frames and forecast verification on Spark DataFrames.

Conventions used throughout:

* time columns are ``timestamp_ntz`` values that hold UTC; the session time zone must be UTC;
* NULL is the only missing marker, NaN is turned into NULL where data enters;
* ``keys`` names the columns that identify a series and must not be NULL in series operators;
* functions take and return DataFrames and run no job, unless their docstring says so.
"""

__version__ = "0.1.0"

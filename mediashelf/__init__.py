"""mediashelf: a Spark-native media catalogue.

Every operator takes DataFrames and returns DataFrames; planning is left to
Catalyst and AQE. See README.md for the operator map.
"""

__version__ = "0.1.0"

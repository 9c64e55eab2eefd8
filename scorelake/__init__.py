"""Scorelake: credit-risk scorecards as Spark DataFrame operators.

Every operator takes DataFrames plus small parameter objects and returns
DataFrames.  Fitted state (breaks, WOE maps, coefficients) is small by
construction and checked; nothing that grows with the rows reaches the driver.
"""

__version__ = "0.1.0"

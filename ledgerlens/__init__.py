"""ledgerlens: card-transaction fraud analytics on Spark DataFrames.

Every operator is a function from DataFrame(s) to a DataFrame; nothing is
collected to the driver except bounded summaries (class counts, quantile cut
points, fitted model coefficients).
"""

__version__ = "0.1.0"

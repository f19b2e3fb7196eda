"""Analytics over event tapes and probability forecasts, as transforms of Spark DataFrames."""

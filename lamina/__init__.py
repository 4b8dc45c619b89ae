"""lamina: labelled arrays, time series, matrices and graphs as Spark DataFrames."""

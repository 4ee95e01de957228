"""Analysis of many time series and regressors on them, written as Spark jobs."""

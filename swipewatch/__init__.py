"""Card-fraud scoring and reporting on Spark DataFrames."""

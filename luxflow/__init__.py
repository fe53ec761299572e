"""luxflow: event-camera recordings as Spark DataFrames."""

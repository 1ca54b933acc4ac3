"""An analytics engine for object graphs on Spark: objects, classes and references as DataFrames."""

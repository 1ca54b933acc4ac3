"""The object graph as DataFrames, and tables that iterative work is cut at."""

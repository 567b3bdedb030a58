"""Operators: DataFrame in, DataFrame out. Fitted values are tables too."""

"""Operators on grids: DataFrame in, DataFrame out."""

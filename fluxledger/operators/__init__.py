"""Operators on logs, changes, groups and catalogues: DataFrame in, DataFrame out."""

"""Cell-indexed zonal analytics on Spark DataFrames.

Polygons become sets of hierarchical grid cells, and every spatial question
becomes an equi-join on a cell id.
"""

"""lodgeprice: listing-price analytics on Spark DataFrames and Spark ML.

Sub-packages
------------
sources    table readers, the derived ``listings``/``requests`` views, file sinks
functions  column-expression builders (parsing, encodings, geo, row statistics)
operators  filters, aggregations, joins, splits, ranking, k-NN
plans      composed jobs: preprocessing, features, comps, scoring, model search
streaming  scoring of arriving request files with Structured Streaming
"""

__all__ = ["sources", "functions", "operators", "plans", "streaming"]

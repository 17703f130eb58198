"""lodegraph: property-graph and data-processing operators on PySpark DataFrames."""

"""storygraph: temporal knowledge graphs over large text collections, as PySpark DataFrames."""

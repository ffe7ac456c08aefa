"""Label and lineage analytics over dependency-fact tables, on Spark DataFrames."""

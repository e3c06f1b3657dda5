"""keystrata: a keyed-table engine on Spark DataFrames."""

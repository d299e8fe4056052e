"""quantloom: panel-data and empirical asset-pricing operators as lazy Spark DataFrames."""

"""mutagrid: mutation-testing analytics and corpus preparation on Spark DataFrames."""

"""hirelake: talent and vacancy matching jobs on Spark DataFrames."""

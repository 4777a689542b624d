"""Set-at-a-time form and workbook analytics on Spark DataFrames."""

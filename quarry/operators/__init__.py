"""Domain operators: functions from DataFrames (and Columns) to DataFrames."""

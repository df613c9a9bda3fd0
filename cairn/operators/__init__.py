"""Operators: functions from DataFrames (and a Rules object) to DataFrames."""

"""Training-data operators: ten stand-alone components over a ``documents`` table.

Nothing outside this package imports it.  Every operator takes DataFrames and
column names, selects only the columns it needs (so extra columns with clashing
names are harmless), and returns a DataFrame.
"""

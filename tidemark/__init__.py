"""Point-in-time market analytics as DataFrame operators.

Every operator takes DataFrames and returns a lazy DataFrame; nothing is
collected and no session is created here.
"""

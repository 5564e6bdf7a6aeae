"""Training-data operators: ten methods for corpora, each a function from DataFrames to a DataFrame.

Nothing outside this folder imports it; the entry module adds its queries only when it can be imported.
"""

"""Training-data operators: text, chat and embedding tables in, DataFrames out."""

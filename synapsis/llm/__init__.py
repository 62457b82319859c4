"""Training-data operators: near and substring de-duplication, quality, tokens, media, WARC, secrets, mixing.

Nothing outside this folder imports it. Every operator takes a DataFrame and column names, reads only the columns
it is told about (so extra columns never clash), and returns a DataFrame.
"""

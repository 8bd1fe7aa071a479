"""Training-data operators (documents, pages, conversations).

Nothing outside this folder imports it; ``queries`` holds the registered queries and their SQL.
"""

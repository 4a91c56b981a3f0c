"""Training-data pipeline operators.

Thirteen operators over text, pages, conversations and vectors, their driver queries and the
small helpers they share. Nothing outside this subpackage imports it.
"""

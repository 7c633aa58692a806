"""Operators that prepare training text for language models, as Spark jobs.

Nothing outside this package imports it, so the folder can be removed without touching the rest of the library.
"""

"""Incremental operators: what a new batch means for the tables already there.

They are plain table functions, so a scheduled batch job and a ``foreachBatch`` callback of a
structured stream can both call them.
"""

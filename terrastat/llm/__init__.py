"""Training-data operators over document, page and benchmark tables.

Nothing else in the library imports this subpackage.  Operators marked native use only
DataFrame and SQL functions on their main path.
"""

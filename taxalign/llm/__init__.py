"""Operators for preparing training corpora.

Nothing else in the package imports this subpackage.  Each module holds one operator;
``queries`` registers them.  Operators take the columns they need by name, so further
columns of a table, whatever their names, are neither read nor touched.
"""

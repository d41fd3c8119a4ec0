"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it.  Each module holds one operator, its query
and, where SQL can say the same, its SQL.
"""

"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it. Each module holds one operator; ``queries`` registers
one query per operator and ``oracles`` the SQL that says the same, where SQL can.
"""

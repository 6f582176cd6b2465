"""Operators for building language-model training data at corpus scale.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own general interface; ``queries`` wires them to the table contract.
"""

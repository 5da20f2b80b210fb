"""Operators for preparing training data.

Nothing outside this subpackage imports it; each module holds one operator with
its own general interface, and ``queries`` holds the thin queries over tables.
"""

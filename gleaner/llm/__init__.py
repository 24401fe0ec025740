"""Operators for preparing language-model training text.

Nothing outside this subpackage imports it.  Each module holds one operator with a general
interface; ``queries`` derives the thin ``opN_<name>`` results from them.
"""

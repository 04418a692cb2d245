"""Operators for preparing language-model training text (the `llm` list).

One module per operator; ``catalogue`` binds each to its ``opN_<name>`` query.
Nothing else in the library imports this subpackage.
"""

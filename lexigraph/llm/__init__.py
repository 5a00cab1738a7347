"""Corpus preparation for language models: ten operators, their queries, and the stages that chain five of them.

Nothing else in the library imports this subpackage.
"""

"""Operators that prepare text corpora for language-model training.

Nothing outside this subpackage imports it.  Each operator is a module with a general interface;
``queries`` derives the fixed result columns of the ``opN_*`` queries from them.
"""

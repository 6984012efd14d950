"""Operators that prepare text corpora for language-model training.

The subpackage stands alone: nothing else in the library imports it.  It uses the general
helpers of ``segflux.sources.sink`` for tables on shared storage.
"""

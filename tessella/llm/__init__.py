"""Operators for preparing training corpora, each a Spark job over a documents-like table.

Nothing else in the library imports this subpackage.  Tasks import it by name, so that
per-worker caches outlive a single task; tessella.shipping sends it to the executors.
"""

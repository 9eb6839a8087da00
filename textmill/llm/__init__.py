"""Training-data operators: deduplication, filters, classifiers, scans.

Nothing outside this subpackage imports it.  Every operator takes and
returns DataFrames, names its columns by parameter and keeps extra columns
of its input out of its way.
"""

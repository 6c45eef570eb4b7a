"""Training-data operators: ten corpus operators written as Spark jobs.

Nothing outside this subpackage imports it; `__spark_entry__.py` adds its
queries when the subpackage is present.
"""

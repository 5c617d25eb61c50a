"""A Spark engine for typed plans over hybrid tables and for the analysis of plan collections."""

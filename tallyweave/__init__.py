"""Survey analytics on Spark: a form-expression compiler, repeat aggregates, lookups, profiling and metadata queries."""

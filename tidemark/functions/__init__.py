"""Column expressions: intervals, text, geometry, scores. All stay inside code generation; none is a UDF."""

"""Column expressions: everything here stays inside whole-stage code generation
where Spark supports it and never starts a Python worker."""

"""Jobs that chain operators: training tables, models, benchmarks and serving."""

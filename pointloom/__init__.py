"""pointloom: localization grouping and posterior summaries as Spark jobs."""

"""Daily futures bulletins, and training-data operators, as Spark jobs."""

"""A typed, Spark-first batch analytics layer: models, expressions and datasets that lower to plain DataFrame plans."""

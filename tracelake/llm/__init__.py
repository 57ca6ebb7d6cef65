"""Training-data operators on Spark: one module per operator, plus the queries and their SQL in ``queries``."""

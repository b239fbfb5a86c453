"""Operations of a training-data pipeline: one module for each operator, queries and SQL beside them."""

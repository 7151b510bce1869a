"""Text analytics and retrieval on Spark: DataFrame operators, column functions and streaming builders."""

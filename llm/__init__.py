"""Operations of a training-data pipeline on Spark: one module for each, queries in ``queries``."""

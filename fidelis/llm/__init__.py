"""Operations of training-data pipelines on Spark."""

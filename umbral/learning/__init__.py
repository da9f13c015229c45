"""Feature preparation, models, tuning, evaluation and scoring on Spark ML."""

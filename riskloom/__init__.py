"""Event-risk analytics on Spark: features, baselines, models, explanations, impact and feedback."""

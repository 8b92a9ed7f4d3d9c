"""Text-corpus operators for training-data pipelines, each one a Spark job."""

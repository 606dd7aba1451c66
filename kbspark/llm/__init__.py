"""Ten operators for training-data pipelines, and their registered queries (see kbspark.llm.registry)."""

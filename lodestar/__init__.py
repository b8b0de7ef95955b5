"""A Spark-first engine for source-code structure, plus optional training-data operators in ``lodestar.llm``."""

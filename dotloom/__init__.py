"""dotloom: counting and matching analytics for vision pipelines as Spark DataFrame operators."""

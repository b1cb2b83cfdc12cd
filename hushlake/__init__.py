"""hushlake: Spark jobs that find, score and remove sensitive data in LLM traffic."""

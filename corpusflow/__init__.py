"""corpusflow: code-corpus analytics as Spark DataFrame plans."""

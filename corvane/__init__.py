"""corvane: Spark-first analytics over biomedical graphs, drug-pair tables and the text around them."""

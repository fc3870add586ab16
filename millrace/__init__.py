"""millrace: a Spark-first engine for math corpora, chat records and answer checking."""

"""pagelode: Spark jobs over crawled website corpora."""

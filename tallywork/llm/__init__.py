"""Corpus preparation for language-model training, as Spark jobs over tables of documents and pages."""

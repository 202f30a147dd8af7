"""corpusloom: a Spark-native engine for versioned, verifiable text corpora."""

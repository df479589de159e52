"""A Spark-native engine that scores, ranks and relates a dated corpus of documents."""

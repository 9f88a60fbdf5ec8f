"""A Spark-native engine for searching, relating and maintaining collections of dated text."""

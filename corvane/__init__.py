"""Spark-native retrieval and coverage analytics over corpora of versioned text files."""

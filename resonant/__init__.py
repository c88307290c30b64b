"""Spark-native retrieval, emotion, topic and graph analytics over short texts and documents."""

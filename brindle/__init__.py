"""Spark-native hybrid search and retrieval over source trees and document tables."""

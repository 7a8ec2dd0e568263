"""A retrieval and audit engine for document corpora on Apache Spark."""

"""Set-at-a-time document retrieval and learning analytics on Spark."""

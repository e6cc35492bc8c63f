"""Small text helpers that run on the rows of a batch; they know nothing of Spark."""

"""ledgerloom: archive, search and analyse conversation histories on Spark."""

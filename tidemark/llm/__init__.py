"""Training-data operators: language, toxicity, search, near and exact duplicates, tokens, shards, WARC, leaks, licences."""

"""What is read out of a repository's files: symbols, manifests, run configurations, README heads, headers."""

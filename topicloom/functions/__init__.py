"""Column-level building blocks: text, keywords, paths, vectors, labels."""

"""Column functions: names and paths, pipeline steps, transform operations, hashes and text."""

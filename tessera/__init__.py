"""Tessera: typed tables with embeddings, answered by Spark plans."""

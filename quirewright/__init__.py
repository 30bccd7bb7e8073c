"""Document analytics on Spark: ingest, clean, section, chunk, embed, search and analyse papers."""

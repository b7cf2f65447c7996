"""Track popularity analytics on Spark: cleaning, enrichment, matching, scoring and diagnosis of track tables."""

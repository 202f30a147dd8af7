"""Training-data operators: secrets, deduplication, quality, fingerprints, decontamination, licences, encoding."""

"""Training-data operators: dedup, fingerprints, chat, decontamination, tokens, scores, personal data, url filters."""

"""Training-data operators: sharding, mixing, near-duplicates, packing, tokens, media, languages, archives, licences."""

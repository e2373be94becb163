"""Training-data operators: language ID, quality, chat, ANN, WARC, secrets, tokens, packing, mixing, near-dedup."""

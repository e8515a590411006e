"""Training-data operators: near-duplicates, repeats, scoring, tokenising, mixing, media."""

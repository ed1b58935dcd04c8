"""Training-data operators: dedup, quality, tokens, decontamination, scoring, HTML, archives, mixing."""

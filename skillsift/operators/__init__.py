"""DataFrame -> DataFrame operators: shaping, de-dup and delta, titles, skill tagging, TF-IDF index, recommendation."""

"""Operations of a training-data pipeline: scoring, deduplication, archives, formatting, mixing, rules, counts, search, packing."""

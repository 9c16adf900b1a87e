"""Training-data operators: counting, scoring, sharding, encoding, de-duplication, mixing."""

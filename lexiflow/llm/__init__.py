"""Training-data operators: near-duplicate search, tokenizing, sharding,
packing, filtering and nearest neighbours as Spark jobs."""

"""DataFrame building blocks: grains, first rows per key, ranks over whole tables."""

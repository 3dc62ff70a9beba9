"""Training-data operators: dedup, sharding, scoring, decontamination, media,
token files and packing. Nothing outside this subpackage imports it."""

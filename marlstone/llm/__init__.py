"""Training-data operators: formatting, cleaning, de-duplication, scanning, mixing and sharding."""

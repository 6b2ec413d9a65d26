"""Training-data operators: de-duplication, classification, tagging, sharding and encoding."""

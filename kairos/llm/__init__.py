"""Training-data operators: archives, extraction, de-duplication, filtering,
scoring, mixing and placement.  Nothing else in kairos imports this package."""

"""Training-data operators at corpus scale: deduplication, decontamination, filters, scoring, mixing."""

"""Driver-side state beside the tables: snapshot pointer, journal, receipts, artifacts, annotations."""

"""notalake: Spark jobs over Brazilian fiscal documents (NF-e, NFC-e, CT-e, MDF-e)."""

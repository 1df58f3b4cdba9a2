"""Column functions: text cleaning, masking, hashing, ids, vectors."""

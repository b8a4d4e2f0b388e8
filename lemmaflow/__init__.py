"""lemmaflow: verification of structured proofs, and preparation of training text, on Spark."""

"""keyfold: keyed state folding, change deltas and corpus preparation on Spark."""

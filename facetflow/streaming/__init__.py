"""Edit logs as batch folds and as streams."""

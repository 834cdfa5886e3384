"""Storage classes and the value model on Columns."""

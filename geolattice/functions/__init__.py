"""Column functions over vectors and small matrices."""

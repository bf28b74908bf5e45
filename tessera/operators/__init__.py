"""Physical pieces that are not plain relational plans."""

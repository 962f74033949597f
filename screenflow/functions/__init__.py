"""Building blocks shared by the operators: ordering, skew handling, text and bit columns."""

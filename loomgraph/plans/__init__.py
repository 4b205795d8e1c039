"""Plain-language questions as plans over the operators."""

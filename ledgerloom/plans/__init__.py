"""The data products: named queries and table builders composed from the operators."""

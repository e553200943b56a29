"""Queries over objects, and the operators that write and check them."""

"""Where objects, products and files come from."""

"""Declared entities, relations and the paths between them."""

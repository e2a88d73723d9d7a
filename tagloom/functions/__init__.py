"""Column to Column functions; Catalyst sees through all of them."""

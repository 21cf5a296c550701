"""Column functions: each takes and returns columns, so that Catalyst plans whole queries of them."""

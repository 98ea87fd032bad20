"""Column functions, all within Catalyst except :mod:`json_values`."""

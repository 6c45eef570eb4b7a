"""Column functions: text, content features, prices."""

"""Training-data operators. Self-contained: nothing else in weftline imports this subpackage."""

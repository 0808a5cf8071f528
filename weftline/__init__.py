"""weftline: a PySpark-native engine for semi-structured text records.

Rules compile to Column expressions; Arrow functions and document parsers are used only where no built-in exists."""

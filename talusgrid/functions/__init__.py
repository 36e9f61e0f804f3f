"""Column functions: everything here maps Columns to a Column and never moves rows."""
